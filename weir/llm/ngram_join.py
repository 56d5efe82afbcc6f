"""N-gram Jaccard join: which documents share three quarters of their word shingles.

Shingles are hashed once and shuffled as packed rows to count in how many
distinct sets each occurs; the counts order the shingles rare first. A shingle
of one set can never match, so only the shared ones go back to their documents,
and a document with less than three quarters of its shingles shared is done.
Documents with equal sets are one class from there on. The prefixes of the
remaining sets are joined on their shingles:

1. Each document meets, under each of its prefix shingles, the document with the
   fewest shingles of its own (its pivot; among near copies that is the original
   or what is nearest to it). Each (document, pivot) is measured once; links make
   components.
2. Two documents of different components that share a prefix shingle share its
   pivot. Either they share a shingle outside the pivot, and then one of the
   prefix of what each has outside it, whose length follows from what the pivot
   already explains; or all they share lies in the pivot, and then the smaller of
   their shares of it must suffice for their sizes. Pairs of either kind pass the
   length, positional and suffix filters and are verified once.

All pairs within a group of near copies are thus never listed, and no link that
could join two components is missed.

Equality of shingles is that of 48 bits of a hash and the bucket (log2 of the
bucket count more bits), within one pair of documents.

Defined results: documents without words have an empty set and link with
nothing; a text of fewer than N words is one shingle; rows without an id are
returned with null numbers; rows that share an id are one document, of the text
with the least hash if their texts differ; texts may be long; columns of other names play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm import packed as P
from weir.llm.common import bucket_count, chunks, per_bucket, saved
from weir.llm.substring_dedup import by_id

N_WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
CELLS = 16
LOW = P.U((1 << 48) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, by row and hash, and their rows."""
    h, at = P.hashed_words(data, offsets, lower=True)
    where, rows = P.inside_rows(at, n)
    a = P.mixed(P.window_hashes(h, n, P.STEP_A)[where])
    counts = np.diff(at)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        sums = np.array([np.sum(h[at[r] : at[r + 1]] * P.powers(P.STEP_B, int(counts[r])), dtype=np.uint64) for r in short.tolist()], np.uint64)
        a = np.concatenate((a, P.mixed(sums + counts[short].astype(P.U))))
        rows = np.concatenate((rows, short))
    order = np.lexsort((a, rows))
    a, rows = a[order], rows[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (rows[1:] != rows[:-1]))) if len(a) else np.zeros(0, bool)
    return a[new], rows[new]


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (P.mixed(ids.astype(P.U)) % P.U(buckets)).astype(np.int64)


def sets(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per id: doc_id, n, sig1, sig2 (equal for equal sets), and for documents that may link with others
    shared (the shingles of two or more sets, rare first) and cells (how many of them fall in each hash cell)."""
    buckets = bucket_count(docs, text)

    def hash_chunk(batches):
        for batch in chunks(batches, "text"):
            batch = by_id(batch)
            ids = batch.column("key").to_numpy()
            a, rows = shingles(*P.flat(batch.column("text")), n)
            sizes = np.bincount(rows, minlength=len(ids))
            full = np.flatnonzero(sizes)
            heads = (np.cumsum(sizes) - sizes)[full]
            sig1, sig2 = np.zeros(len(ids), P.U), np.zeros(len(ids), P.U)
            if len(full):
                sig1[full] = np.add.reduceat(P.mixed(a ^ P.STEP_A), heads)
                sig2[full] = np.add.reduceat(P.mixed(a ^ P.STEP_B), heads)
            seen, first = set(), np.zeros(len(ids), bool)
            for r in full.tolist():
                if (s := (sig1[r], sig2[r])) not in seen:
                    seen.add(s)
                    first[r] = True
            ship = first[rows]
            h = a[ship]
            yield P.pack(((h >> P.U(32)) * P.U(buckets) >> P.U(32)).astype(np.int64), h, ids[rows[ship]], None, width=6)
            home = _home(ids, buckets)
            for kind, values in ((1, sig1), (2, sig2), (3, sizes.astype(P.U))):
                yield P.pack(home, values, ids, None, kind=kind)

    def count(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        h, d, _ = P.unpack(table.filter(pa.array(kinds == 0)), width=6)
        out = [table.filter(pa.array(kinds > 0))]
        if len(h):
            order = np.argsort(h, kind="stable")
            k = h[order]
            head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(head, len(k)))
            df = np.repeat(sizes, sizes)
            order, df = order[df > 1], df[df > 1]
            back = np.argsort(d[order], kind="stable")
            order, df = order[back], df[back]
            top = P.U(table.column("bucket")[0].as_py() & 0xFFFF) << P.U(48)
            out.append(pa.Table.from_batches([P.pack(_home(d[order], buckets), h[order] | top, d[order], df, kind=4)]))
        return pa.concat_tables(out)

    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("shared", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32()))]
    schema = "doc_id long, n long, sig1 long, sig2 long, shared array<long>, cells array<int>"

    def gather(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        (sig1, ids, _), (sig2, _, _), (size, _, _) = (P.unpack(table.filter(pa.array(kinds == k))) for k in (1, 2, 3))
        ids, at = np.unique(ids, return_index=True)
        size = size[at].astype(np.int64)
        h, d, df = P.unpack(table.filter(pa.array(kinds == 4)))
        order = np.lexsort((h, df, d))
        h, row = h[order], np.searchsorted(ids, d[order])
        have = np.bincount(row, minlength=len(ids))
        may = (have > 0) & (100 * have >= percent * size)
        use = may[row]
        h, row = h[use], row[use]
        lists = pa.ListArray.from_arrays(pa.array(_with_nulls(np.where(may, have, 0), may), pa.int32()), pa.array(h.view(np.int64)))
        cells = np.bincount(row * CELLS + (h & P.U(CELLS - 1)).astype(np.int64), minlength=len(ids) * CELLS).astype(np.int32).reshape(-1, CELLS)[may].ravel()
        cell_lists = pa.ListArray.from_arrays(pa.array(_with_nulls(np.where(may, CELLS, 0), may), pa.int32()), pa.array(cells))
        return pa.Table.from_arrays([pa.array(ids), pa.array(size), pa.array(sig1[at].view(np.int64)), pa.array(sig2[at].view(np.int64)), lists, cell_lists], schema=pa.schema(fields))

    rows = one_text_each(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")))
    counted = per_bucket(rows.mapInArrow(hash_chunk, P.SCHEMA), buckets, count, P.SCHEMA)
    return per_bucket(counted, buckets, gather, schema)


def one_text_each(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text) without those whose key has another text with a smaller hash. Texts are only moved if there are such keys."""
    h = F.xxhash64("text")
    several = saved(rows.groupBy("key").agg(F.min(h).alias("least"), F.max(h).alias("most")).where("least <> most").select("key", "least"), "several")
    if several.isEmpty():
        return rows
    return rows.join(several, "key", "left").where(F.col("least").isNull() | (h == F.col("least"))).select("key", "text")


def _with_nulls(sizes: np.ndarray, valid: np.ndarray) -> list:
    """List offsets; a null one makes the list that begins there null."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return [int(e) if v else None for e, v in zip(ends[:-1], valid, strict=True)] + [int(ends[-1])]


def _at_least(nx: Column, ny: Column, percent: int) -> Column:
    """The smallest overlap that links sets of these sizes."""
    return F.ceil(percent * (nx + ny) / F.lit(100 + percent))


def _length_fits(nx: Column, ny: Column, percent: int) -> Column:
    return (100 * nx >= percent * ny) & (100 * ny >= percent * nx)


def _bin(n: Column) -> Column:
    """Sizes within some hundredths of each other share a bin or have neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1.0))) / F.log(F.lit(1.03))).cast("int")


def _verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The linked (x, y) of ``pairs``: the suffix filter by hash cells, then the sets themselves."""
    side = lambda s: reps.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("shared").alias(f"shared{s}"), F.col("cells").alias(f"cells{s}"))
    need = _at_least(F.col("nx"), F.col("ny"), percent)
    by_cell = F.aggregate(F.zip_with("cellsx", "cellsy", lambda a, b: F.least(a, b)), F.lit(0), lambda a, c: a + c)
    both = pairs.join(side("x"), "x").join(side("y"), "y").where(by_cell >= need)
    return both.where(F.size(F.array_intersect("sharedx", "sharedy")) >= need).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of every document in ``links`` (x, y): the smallest id reachable.

    Labels take the least label around them and then their label's label, until nothing changes; each round is a table in the shared folder."""
    edges = saved(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("x").alias("doc_id")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        around = edges.join(labels.select(F.col("doc_id").alias("y"), "component"), "y").groupBy(F.col("x").alias("doc_id")).agg(F.min("component").alias("around"))
        least = labels.join(around, "doc_id").select("doc_id", F.col("component").alias("was"), F.least("component", "around").alias("c"))
        jump = labels.select(F.col("doc_id").alias("c"), F.col("component").alias("beyond"))
        new = saved(least.join(jump, "c").select("doc_id", "was", F.least("c", "beyond").alias("component")), "labels")
        labels = new.drop("was")
        if new.where("was <> component").isEmpty():
            return labels


def linked(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per id: doc_id, n_shingles, class_id (smallest id of an equal set), component_id."""
    every = saved(sets(docs, n, percent, text, key), "sets")
    # only classes of several documents: a table of its own, so that a join with a class of very many can be split
    classes = saved(every.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "classes")
    copies = every.join(classes, ["sig1", "sig2", "n"]).where("doc_id <> rep").select("doc_id")
    reps = saved(every.where("shared is not null").join(copies, "doc_id", "left_anti").select("doc_id", "n", "shared", "cells"), "reps")
    rare = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + 1 - rare
    prefix = F.slice("shared", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    prefixes = saved(reps.select("doc_id", rare.alias("rare"), F.explode(prefix).alias("shingle")), "prefixes")

    # stars: every (document, pivot), measured once
    pivots = prefixes.groupBy("shingle").agg(F.min(F.struct("rare", "doc_id")).alias("p"), F.count("*").alias("c")).where("c > 1")
    pairs = prefixes.join(pivots, "shingle").select("doc_id", F.col("p.doc_id").alias("pivot")).where("doc_id <> pivot").distinct()
    x = reps.select("doc_id", "n", "shared")
    y = reps.select(F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("shared").alias("pivot_shared"))
    outside = F.array_except("shared", "pivot_shared")  # in order, rare first
    common = F.size("shared") - F.size(outside)
    must = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / F.lit(100)) - common)
    first = F.slice(outside, F.lit(1), F.greatest(F.size(outside) - must + 1, F.lit(0)).cast("int"))
    stars = saved(pairs.join(y, "pivot").join(x, "doc_id").select("doc_id", "pivot", "n", "pivot_n", common.alias("common"), F.size(outside).alias("n_outside"), first.alias("outside")), "stars")
    links = stars.where(F.col("common") >= _at_least(F.col("n"), F.col("pivot_n"), percent)).select(F.col("pivot").alias("x"), F.col("doc_id").alias("y"))
    found = components(links)

    # what is left: documents of different components around one pivot
    placed = stars.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("pivot").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("pivot")
    open_ = saved(placed.join(mixed, "pivot", "left_semi"), "open")
    side = lambda t, s, *by: t.select(*by, F.struct("doc_id", "n", "common", "component").alias(s))
    a, b = F.col("a"), F.col("b")
    ordered = [F.least(a["doc_id"], b["doc_id"]).alias("x"), F.greatest(a["doc_id"], b["doc_id"]).alias("y")]
    need = _at_least(a["n"], b["n"], percent)
    apart = (a["component"] != b["component"]) & _length_fits(a["n"], b["n"], percent)
    # either they share a shingle outside the pivot, and then one of their prefixes there ...
    out_of = open_.select("*", F.posexplode("outside").alias("place", "shingle"))
    at = lambda s: F.struct("doc_id", "n", "common", "component", "place", (F.col("n_outside") - 1 - F.col("place")).alias("after")).alias(s)
    by_place = F.least(a["common"], b["common"]) + F.least(a["place"], b["place"]) + 1 + F.least(a["after"], b["after"])
    by_shingle = out_of.select("pivot", "shingle", at("a")).join(out_of.select("pivot", "shingle", at("b")), ["pivot", "shingle"])
    by_shingle = by_shingle.where(apart & (a["doc_id"] < b["doc_id"]) & (by_place >= need)).select(*ordered)
    # ... or all they share is in the pivot, and the smaller share of the two is enough for their sizes
    # for both, so the smaller set has at least 2 p / (100 + p) of itself in the pivot, and the larger (a) allows only so large a smaller one
    inside = open_.where(100 * F.col("common") >= percent * F.col("n"))
    smaller = inside.where((100 + percent) * F.col("common") >= 2 * percent * F.col("n"))
    least, most = percent * F.col("n") / 100, F.least(F.col("n").cast("double"), (100 + percent) * F.col("common") / percent - F.col("n"))
    larger = inside.where(most >= least).withColumn("bin", F.explode(F.sequence(_bin(least - 0.001), _bin(most + 0.001))))
    smaller = smaller.withColumn("bin", _bin(F.col("n")))
    # and one of them does not link with the pivot, as both would be of its component otherwise
    far = F.col("common") < _at_least(F.col("n"), F.col("pivot_n"), percent)
    meet = lambda x, y: side(x, "a", "pivot", "bin").join(side(y, "b", "pivot", "bin"), ["pivot", "bin"])
    by_size = meet(larger.where(far), smaller).union(meet(larger.where(~far), smaller.where(far)))
    by_size = by_size.where(apart & (b["n"] <= a["n"]) & (F.least(a["common"], b["common"]) >= need)).select(*ordered)
    rest = by_shingle.union(by_size).distinct().join(stars.select(F.least("doc_id", "pivot").alias("x"), F.greatest("doc_id", "pivot").alias("y")), ["x", "y"], "left_anti")
    more = saved(_verified(rest, reps, percent), "links")
    if not more.isEmpty():
        found = components(links.union(more))

    out = every.join(classes, ["sig1", "sig2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"))
    out = out.join(found.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
    out = out.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    nameless = docs.where(F.col(key).isNull()).select(*[F.lit(None).cast("bigint").alias(c) for c in out.columns])
    return out.union(nameless)
