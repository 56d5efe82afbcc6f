"""Suffix-array dedup: bytes covered by a 50-byte string that an earlier document holds are removed.

A full suffix array of the corpus would shuffle 50 bytes for every byte, so the
array is sparse, and the sparseness loses nothing: every SIZE-byte window has an
anchor, the leftmost least hash among its GRAM-byte strings, and equal windows
have equal anchors at equal distances. A suffix is kept for each anchor, with
the bytes before it that its windows reach.

1. Anchors that only one document has cannot match; their hashes are counted as
   packed rows and only anchors of two or more documents go back to their texts.
2. The suffixes at those anchors are dealt to buckets by splitters sampled from
   the leading bytes of suffixes. Suffixes that start with the same GRAM bytes
   meet in one bucket, as a splitter cuts only between different leading bytes:
   no comparison is left across a boundary.
   Leads that are frequent in the sample would fill a bucket: their windows are
   dealt one by one, by the hash of the window, so that a line or passage of a
   great many documents is spread over all buckets and equal windows of a chunk
   are one entry. The sample decides only where bytes meet; what meets is sorted
   and compared byte by byte either way.
3. Each bucket sorts its suffixes (multikey, eight bytes at a time, only ties go
   on), sorts the bytes before them likewise, and takes common prefix lengths of
   neighbours. For each distance of a window to its anchor, the runs of long
   enough prefixes on both sides are the equal windows; all but those of the
   smallest document are marked.
4. Marks go back to their documents and merge into maximal byte intervals.

Within a chunk, suffixes equal in all the bytes their windows reach are compared
first, and only that of the smallest document is shuffled.

Defined results: null and empty texts have no bytes; texts shorter than SIZE
stay whole; a document without an id is not compared and stays whole; repeats
within a document and rows that share an id are no duplicates of each other, so
repeated rows stay alike; texts may be long, they are worked on piece by piece;
columns named like a result or ``removed`` are replaced; an empty table gives an
empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import packed as P
from weir.llm.common import bucket_count, chunks, per_bucket, saved
from weir.llm.substring_dedup import by_id, intervals

SIZE = 50
GRAM = 20
#: Window starts, and suffixes, that one numpy step works on.
STEP, STEP_SUFFIXES = 1 << 19, 1 << 13
#: How many texts are sampled for splitters.
SAMPLED_DOCS = 2000
#: Leads of so many sampled suffixes are dealt window by window; how many leads may be.
FREQUENT, MAX_FREQUENT = 16, 2000


def anchors(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """(position, hash, first window, last window, row) of each anchor; positions count in ``data``.

    Long texts are worked on piece by piece; an anchor with windows on both sides of a cut comes twice, with its windows divided."""
    parts = []
    for at in range(0, max(1, len(data) - size + 1), STEP):
        piece = data[at : at + STEP + size - 1]
        found = _piece_anchors(piece, np.clip(offsets - at, 0, len(piece)), size, gram)
        parts.append((found[0] + at, found[1], found[2] + at, found[3] + at, found[4]))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _piece_anchors(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    wide = size - gram + 1
    windows, rows = P.inside_rows(offsets, size)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none.astype(P.U), none, none, none
    h = P.mixed(P.window_hashes(P.BYTE[data], gram, P.STEP_A))
    bits = P.U(21)  # for places in a piece, as many in every piece: equal windows must break ties alike
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done < wide:  # least of windows of 1, 2, 4, ... and at last ``wide`` neighbours
        step = min(done, wide - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    at = (least[windows] & ((P.U(1) << bits) - P.U(1))).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]))))
    tail = np.append(head[1:], len(at)) - 1
    return at[head], h[at[head]], windows[head], windows[tail], rows[head]


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (n x k numbers), and the length in columns that each shares with the one before."""
    n, k = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    shared = np.zeros(n, np.int64)
    tied = np.concatenate(([False], words[order[1:], 0] == words[order[:-1], 0])) if n else np.zeros(0, bool)
    for c in range(1, k):
        shared[tied] = c
        group = np.cumsum(~tied)
        inside = tied | np.append(tied[1:], False)
        where = np.flatnonzero(inside)
        if not len(where):
            return order, shared
        part = order[where]
        order[where] = part[np.lexsort((words[part, c], group[where]))]
        tied[1:] &= words[order[1:], c] == words[order[:-1], c]
    shared[tied] = k
    return order, shared


def common_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows (n x k), and how many bytes each shares with the one before."""
    n, k = rows.shape
    full = np.zeros((n, -(-k // 8) * 8), np.uint8)
    full[:, :k] = rows
    words = full.view(">u8").astype(np.uint64)
    order, shared = multikey_order(words)
    out = np.zeros(n, np.int64)
    differ = shared < words.shape[1]
    x = np.flatnonzero(differ & (np.arange(n) > 0))
    a, b = (full[order[y]].reshape(len(x), words.shape[1], 8) for y in (x, x - 1))
    cell = shared[x]
    pick = np.arange(len(x))
    out[x] = cell * 8 + np.argmax(a[pick, cell] != b[pick, cell], axis=1)
    out[~differ] = k
    return order, np.minimum(out, k)


def match_windows(context: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray, before: int) -> list[tuple[int, np.ndarray]]:
    """For each distance to the anchor: the suffixes whose window at it is also in a smaller document.

    ``context`` holds ``before`` bytes to the left of each anchor and SIZE from it on; suffix k has windows at distances high[k] .. low[k]."""
    size = context.shape[1] - before
    right, right_shared = common_prefixes(context[:, before:])
    left, left_shared = common_prefixes(context[:, :before][:, ::-1])
    out = []
    for o in range(before + 1):
        use = np.flatnonzero((high <= o) & (o <= low))
        if len(use) < 2:
            continue
        r, l = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
        r[right] = np.cumsum(right_shared < size - o)
        l[left] = np.cumsum(left_shared < o)
        key = r[use] * (len(docs) + 1) + l[use]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        twin = np.concatenate(([False], same)) | np.append(same, False)
        order, k = order[twin], k[twin]
        order = order[np.lexsort((docs[use[order]], k))]
        k, d = key[order], docs[use[order]]
        if not len(k):
            continue
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.repeat(d[head], np.diff(np.append(head, len(k))))
        out.append((o, use[order[d > least]]))
    return out


def in_smaller(order: np.ndarray, new: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which entries have an equal one in a smaller document: in ``order`` equal ones are neighbours, ``new`` says where others begin."""
    out = np.zeros(len(docs), bool)
    if len(docs):
        head = np.flatnonzero(new)
        out[order] = docs[order] > np.repeat(np.minimum.reduceat(docs[order], head), np.diff(np.append(head, len(docs))))
    return out


def equal_windows(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows, rows of bytes, are also in a smaller document."""
    if not len(rows):
        return np.zeros(0, bool)
    order, shared = common_prefixes(rows)
    return in_smaller(order, shared < rows.shape[1], docs)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors have small hashes, so the hash is mixed again."""
    return (P.mixed(h ^ P.STEP_B) % P.U(buckets)).astype(np.int64)


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (P.mixed(ids.astype(P.U)) % P.U(buckets)).astype(np.int64)


def repeated_anchors(docs: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """(key, grams): hashes of the anchors of each document that other documents have too."""

    def hash_chunk(batches):
        for batch in chunks(batches, "text"):
            batch = by_id(batch)
            ids = batch.column("key").to_numpy()
            _, h, _, _, rows = anchors(*P.flat(batch.column("text")), size, gram)
            d = ids[rows]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, bool)
            h, d = h[new], d[new]  # once a document
            head = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            many = ~head | np.append(~head[1:], False) if len(h) else head
            for pick, kind in ((head, 0), (many, 1)):  # one entry a chunk is compared; what the chunk shows already passes
                k = np.flatnonzero(pick)
                k = k[np.argsort(d[k], kind="stable")]
                if len(k):
                    yield P.pack(_home(d[k], buckets) if kind else _buckets(h[k], buckets), h[k], d[k], None, kind=kind, width=8 if kind else 6)

    def count(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds == 1))]
        h, d, _ = P.unpack(table.filter(pa.array(kinds == 0)), width=6)
        if len(h):
            order = np.argsort(h, kind="stable")
            k = h[order]
            same = k[1:] == k[:-1]
            twin = np.concatenate(([False], same)) | np.append(same, False)
            order = order[twin]
            order = order[np.argsort(d[order], kind="stable")]
            out.append(pa.Table.from_batches([P.pack(_home(d[order], buckets), h[order], d[order], None, kind=1)]))
        return pa.concat_tables(out)

    fields = pa.schema([("key", pa.int64()), ("grams", pa.binary())])

    def gather(table: pa.Table) -> pa.Table:
        h, d, _ = P.unpack(table)
        h &= P.U((1 << 48) - 1)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        head = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else np.zeros(0, np.int64)
        cells = [h[a:b].astype("<u8").tobytes() for a, b in zip(head.tolist(), [*head[1:].tolist(), len(d)], strict=True)] if len(d) else []
        return pa.Table.from_arrays([pa.array(d[head]), pa.array(cells, pa.binary())], schema=fields)

    rows = docs.where("key is not null and text is not null")
    counted = per_bucket(rows.mapInArrow(hash_chunk, P.SCHEMA), buckets, count, P.SCHEMA)
    return saved(per_bucket(counted, buckets, gather, "key long, grams binary"), "grams")


def _all_leads(size: int, gram: int):
    def run(batches):
        for batch in chunks(batches, "text"):
            data, offsets = P.flat(batch.column("text"))
            at = np.unique(anchors(data, offsets, size, gram)[0])
            yield pa.RecordBatch.from_arrays([pa.array([data[p : p + gram].tobytes() for p in at.tolist()], pa.binary())], ["lead"])

    return run


def frequent_leads(sample: DataFrame, size: int, gram: int) -> np.ndarray:
    """Sorted leading strings that at least FREQUENT suffixes of the sample share, MAX_FREQUENT at most; they only steer how suffixes are dealt."""
    leads = sample.mapInArrow(_all_leads(size, gram), "lead binary").groupBy("lead").agg(F.count("*").alias("n"))
    top = leads.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "lead").limit(MAX_FREQUENT).collect()
    return np.array(sorted(bytes(r.lead) for r in top), f"S{gram}")


def splitters(sample: DataFrame, buckets: int, size: int, gram: int) -> np.ndarray:
    """Up to buckets - 1 leading strings that cut a sample of suffixes into equal shares; each batch gives at most 8 suffixes for each of its documents."""

    def leading(batches):
        for batch in chunks(batches, "text"):
            data, offsets = P.flat(batch.column("text"))
            at, _, _, _, rows = anchors(data, offsets, size, gram)
            pick = np.random.default_rng(7).permutation(len(at))[: 8 * batch.num_rows]
            yield pa.RecordBatch.from_arrays([pa.array([data[p : p + gram].tobytes() for p in at[pick].tolist()], pa.binary())], ["lead"])

    leads = sorted(bytes(r.lead) for r in sample.mapInArrow(leading, "lead binary").collect())
    cuts = sorted({leads[k * len(leads) // buckets] for k in range(1, buckets)}) if leads else []
    return np.array(cuts, f"S{gram}")


def marked_windows(texts: DataFrame, size: int = SIZE, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int]:
    """Packed rows of kind 1, grouped by document: starts of windows that a smaller document has; and the number of buckets."""
    docs = texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    buckets = bucket_count(docs)
    before = size - gram
    width = before + size + 2
    some = docs.where("text is not null").select("text").sample(min(1.0, SAMPLED_DOCS / max(docs.count(), 1)), seed=11)
    cuts, frequent = splitters(some, buckets, size, gram), frequent_leads(some, size, gram)

    def suffixes(batches):
        for batch in chunks((b.filter(b.column("grams").is_valid()) for b in batches), "text"):
            batch = by_id(batch)
            ids = batch.column("key").to_numpy()
            data, offsets = P.flat(batch.column("text"))
            at, h, first, last, rows = anchors(data, offsets, size, gram)
            grams = batch.column("grams")
            use = np.zeros(len(at), bool)
            bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
            h &= P.U((1 << 48) - 1)
            for r in range(len(ids)):
                a, b = int(bounds[r]), int(bounds[r + 1])
                if b > a and (g := grams[r].as_py()):
                    g = np.frombuffer(g, "<u8")
                    use[a:b] = g[np.minimum(np.searchsorted(g, h[a:b]), len(g) - 1)] == h[a:b]
            k = np.flatnonzero(use)
            if not len(k):
                continue
            at, first, last, rows = at[k], first[k], last[k], rows[k]
            low, high = at - first, at - last
            record = np.zeros((len(k), width), np.uint8)
            reach = np.arange(-before, size)
            for i in range(0, len(k), STEP_SUFFIXES):
                j = slice(i, i + STEP_SUFFIXES)
                valid = (reach >= -low[j, None]) & (reach < size - high[j, None])
                record[j, : before + size] = np.where(valid, data[np.clip(at[j, None] + reach, 0, len(data) - 1)], 0)
            record[:, -2], record[:, -1] = low, high
            d, p = ids[rows], at - offsets[rows]
            whole = np.ascontiguousarray(record).view(f"V{width}").ravel()
            lead = np.ascontiguousarray(record[:, before : before + gram]).view(f"S{gram}").ravel()
            _, head, group = np.unique(whole, return_index=True, return_inverse=True)
            least = d[head][group]  # rows are by id, so the first of equal records has the smallest
            ship = d == least
            gone = ~ship
            if len(frequent):
                hot = frequent[np.minimum(np.searchsorted(frequent, lead), len(frequent) - 1)] == lead
                yield from windows_of(data, offsets, ids, rows, at, low, high, np.flatnonzero(ship & hot))
                ship &= ~hot
            yield P.pack(np.searchsorted(cuts, lead[ship], "right"), record[ship], d[ship], p[ship])
            if gone.any():
                n = (low - high + 1)[gone]
                starts = np.repeat((p - low)[gone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield P.pack(_home(d[gone], buckets).repeat(n), None, d[gone].repeat(n), starts, kind=1)

    def windows_of(data, offsets, ids, rows, at, low, high, k):
        """Suffixes with a frequent lead window by window: equal windows meet by their hash, whatever surrounds the rest of the suffix."""
        n = (low - high + 1)[k]
        starts = np.repeat((at - low)[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(rows[k], n)
        h = np.zeros(len(starts), P.U)
        for i in range(0, len(starts), STEP_SUFFIXES):
            x = P.BYTE[data[starts[i : i + STEP_SUFFIXES, None] + np.arange(size)]]
            h[i : i + STEP_SUFFIXES] = P.mixed((x * P.powers(P.STEP_A, size)).sum(axis=1, dtype=np.uint64))
        d, p = ids[row], starts - offsets[row]
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order[1:]] != h[order[:-1]])) if len(h) else np.zeros(0, bool)
        for i in range(0, len(order), STEP_SUFFIXES):  # equal hashes, equal bytes: then one of a chunk is enough
            j = np.arange(max(i, 1), min(i + STEP_SUFFIXES, len(order)))
            differ = (data[starts[order[j], None] + np.arange(size)] != data[starts[order[j - 1], None] + np.arange(size)]).any(axis=1)
            new[j] |= differ
        gone = in_smaller(order, new, d)
        stay = np.flatnonzero(~gone)
        for i in range(0, len(stay), STEP):
            s = stay[i : i + STEP]
            yield P.pack((h[s] % P.U(buckets)).astype(np.int64), data[starts[s, None] + np.arange(size)], d[s], p[s], kind=2)
        yield P.pack(_home(d[gone], buckets), None, d[gone], p[gone], kind=1)

    def compare(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds == 1))]
        record, d, p = P.unpack(table.filter(pa.array(kinds == 2)), width=size)
        gone = equal_windows(record, d)
        if gone.any():
            d, p = d[gone], p[gone]
            order = np.lexsort((p, d))
            out.append(pa.Table.from_batches([P.pack(_home(d[order], buckets), None, d[order], p[order], kind=1)]))
        record, d, p = P.unpack(table.filter(pa.array(kinds == 0)), width=width)
        if len(d) > 1:
            found = match_windows(record[:, :-2], record[:, -2].astype(np.int64), record[:, -1].astype(np.int64), d, before)
            at = np.concatenate([x for _, x in found] + [np.zeros(0, np.int64)])
            starts = np.concatenate([p[x] - o for o, x in found] + [np.zeros(0, np.int64)])
            order = np.lexsort((starts, d[at]))
            out.append(pa.Table.from_batches([P.pack(_home(d[at[order]], buckets), None, d[at[order]], starts[order], kind=1)]))
        return pa.concat_tables(out)

    # a left join, as the last step has one of the same texts: Spark shuffles them once for both
    joined = texts.join(repeated_anchors(docs, size, gram, buckets).withColumnRenamed("key", key), key, "left")
    shipped = joined.select(F.col(key).alias("key"), F.col(text).alias("text"), "grams").mapInArrow(suffixes, P.SCHEMA)
    return per_bucket(shipped, buckets, compare, P.SCHEMA), buckets


def deduplicated(docs: DataFrame, size: int = SIZE, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    keep = [c for c in docs.columns if c not in (*names, "removed")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in names[:3]] + [T.StructField("kept", T.BinaryType())])
    texts = docs.select(*keep)
    removed = intervals(*marked_windows(texts, size, gram, text, key), size, "key")
    joined = texts.join(removed.withColumnRenamed("key", key), key, "left").select(*keep, "removed")

    def cut(batches):
        for batch in chunks(batches, text):
            counts, gone, runs, kept = [], [], [], []
            for t, r in zip(batch.column(text), batch.column("removed").to_pylist(), strict=True):
                raw = t.as_py().encode() if t.is_valid else b""
                counts.append(len(raw))
                runs.append(len(r or []))
                at, parts = 0, []
                for x in r or []:
                    parts.append(raw[at : x["start"]])
                    at = x["stop"]
                kept.append(b"".join([*parts, raw[at:]]))
                gone.append(counts[-1] - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, pa.int64()) for c in (counts, gone, runs)], pa.array(kept, pa.binary())], [*keep, *names])

    return joined.mapInArrow(cut, schema)
