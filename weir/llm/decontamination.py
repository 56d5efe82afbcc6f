"""Benchmark decontamination: which documents hold a window that is nearly a benchmark item.

All of it is DataFrame operations.

1. Word and five-word shingle hashes of each text are computed once; documents
   without any shingle of an item are done. The test is a literal set while the
   items have at most MAX_LITERAL shingles, else a join on the shingle.
2. Each shared shingle puts a window of the item's size on its diagonal, cut at
   the document's ends. Windows of equal words are one class.
3. A class has the SimHash of its words (a bit is set if it is set in more than
   half of them). A multi-index finds every item within RADIUS bits: 64 bits cut
   into RADIUS + 1 blocks agree in at least one block, so the join on a block and
   its value, filtered by the distance, misses none.
4. No radius holds every pair of the wanted similarity: a window that a document's
   end cuts, or a block of other words at an end, moves more bits than scattered
   edits. So pairs are also joined on the shingles: similar multisets share a
   shingle among their rarest few (prefixes; rare by the number of items), which
   misses none at any similarity above 0.
5. Each pair is verified once by the exact similarity of the shingles with
   their multiplicities as weights: the sum of least over the sum of most.

Defined results: null and empty texts are clean; items of fewer than five words
or without text are not searched; rows without an id are dropped from the
matches and are clean in the verdict; repeated rows and repeated items are alike;
of items that share an id the one with the least word hashes counts; texts and
items may be as long as an array; extra columns play no part; without documents
or without items nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import once, saved, words

N_WORDS = 5
SIMILARITY = 0.75
RADIUS = 11
#: Shingles of items that may be a literal in the plan; a larger set is joined.
MAX_LITERAL = 20_000
BITS = 64


def _word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _shingles(hashes: Column) -> Column:
    """The shingle that starts at each word; ``hashes`` is a column of the table."""
    whole = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (N_WORDS - 1), F.lit(0)))
    return F.transform(whole, lambda w, i: F.xxhash64(w, *[F.get(hashes, i + k) for k in range(1, N_WORDS)]))


def fingerprints(table: DataFrame, ids: list[str], hashes: str) -> DataFrame:
    """``ids`` and fp, the SimHash of the words in ``hashes``. Each of 32 sums holds the counts of two bits; an array has fewer than 2**31 words, so neither can overflow."""
    one, half = F.lit(1).cast("bigint"), BITS // 2
    bit = lambda b: F.shiftrightunsigned("__w", b).bitwiseAND(one)
    both = lambda b: bit(b).bitwiseOR(F.shiftleft(bit(b + half), half))
    sums = table.select(*ids, F.explode(hashes).alias("__w")).groupBy(*ids).agg(F.count("*").alias("__n"), *[F.sum(both(b)).alias(f"__s{b}") for b in range(half)])
    fp = F.lit(0).cast("bigint")
    for b in range(BITS):
        ones = F.shiftrightunsigned(f"__s{b % half}", half * (b // half)).bitwiseAND(F.lit((1 << half) - 1).cast("bigint"))
        fp = fp.bitwiseOR(F.when(2 * ones > F.col("__n"), F.shiftleft(one, b)).otherwise(F.lit(0).cast("bigint")))
    return sums.select(*ids, fp.alias("fp"))


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(block, value) of each of radius + 1 blocks."""
    n, at, out = radius + 1, 0, []
    for k in range(n):
        width = BITS // n + (k < BITS % n)
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        out.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def prefixes(table: DataFrame, ids: list[str], rarity: DataFrame, similarity: float) -> DataFrame:
    """``ids``, size, shingle and copy: the rarest shingles of each row, one of which a row at least ``similarity`` alike has among its own.

    The copies of a shingle are numbered, so that multisets are sets. ``rarity`` gives the items of a shingle; a shingle of none is the rarest and meets nothing."""
    counted = table.select(*ids, F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")).groupBy(*ids, "size", "shingle").agg(F.count("*").alias("n"))
    ranked = counted.join(rarity, "shingle", "left").select(*ids, "size", F.struct(F.coalesce("items", F.lit(0)).alias("items"), "shingle", "n").alias("one"))
    listed = ranked.groupBy(*ids, "size").agg(F.array_sort(F.collect_list("one")).alias("all"))
    copies = F.flatten(F.transform("all", lambda s: F.transform(F.sequence(F.lit(1), s["n"]), lambda k: F.struct(s["items"].alias("items"), s["shingle"].alias("shingle"), k.alias("copy")))))
    # a row of this size shares at least similarity * size shingles; the small number keeps rounding from cutting one off
    length = F.col("size") - F.ceil(similarity * F.col("size") - 1e-6).cast("int") + 1
    return listed.select(*ids, "size", F.inline(F.slice(copies, F.lit(1), length))).where(F.col("items") > 0).drop("items")


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, radius: int = RADIUS, max_literal: int = MAX_LITERAL) -> DataFrame:
    """(key, item_id, start, stop, similarity): windows of words, stop exclusive, that are nearly an item."""
    bench = items.where(F.col("item_id").isNotNull()).select("item_id", _word_hashes(F.col("text")).alias("words"))
    bench = bench.where(F.size("words") >= N_WORDS).groupBy("item_id").agg(F.min("words").alias("words"))
    bench = saved(bench.withColumn("shingles", _shingles(F.col("words"))), "items")
    wanted = bench.select("item_id", F.size("words").alias("m"), F.posexplode("shingles").alias("j", "shingle"))
    distinct = wanted.select("shingle").distinct()

    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = once(once(source, {"words": _word_hashes(F.col("text"))}), {"shingles": _shingles(F.col("words"))}).select("key", "words", "shingles")
    literal = [r.shingle for r in distinct.limit(max_literal + 1).collect()]
    if len(literal) <= max_literal:
        at = F.transform("shingles", lambda h, i: F.when(h.isin(literal), F.struct(i.alias("i"), h.alias("shingle"))))
        held = once(hashed, {"hits": F.filter(at, lambda x: x.isNotNull())}).where(F.size("hits") > 0).select("key", "words", "hits")
    else:
        single = hashed.select("key", F.posexplode("shingles").alias("i", "shingle")).join(distinct, "shingle")
        listed = single.groupBy("key").agg(F.collect_set(F.struct("i", "shingle")).alias("hits"))
        held = hashed.select("key", "words").join(listed, "key")
    held = saved(held, "held")

    on_diagonal = held.select("key", F.size("words").alias("n"), F.inline("hits")).join(wanted, "shingle")
    start = F.greatest(F.col("i") - F.col("j"), F.lit(0))
    stop = F.least(F.col("i") - F.col("j") + F.col("m"), F.col("n"))
    spots = on_diagonal.select("key", start.alias("start"), stop.alias("stop")).distinct()
    listed = spots.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spots"))
    windows = held.select("key", "words").join(listed, "key").select("key", "words", F.inline("spots"))
    windows = windows.select("key", "start", "stop", F.slice("words", F.col("start") + 1, F.col("stop") - F.col("start")).alias("words"))
    windows = saved(windows.withColumns({"c1": F.xxhash64("words"), "c2": F.xxhash64(F.lit(1), "words")}), "windows")
    classes = saved(windows.groupBy("c1", "c2").agg(F.min("words").alias("words")).withColumn("shingles", _shingles(F.col("words"))).where(F.size("shingles") > 0), "classes")

    a = fingerprints(classes, ["c1", "c2"], "words").select("c1", "c2", "fp", F.inline(blocks(F.col("fp"), radius)))
    b = fingerprints(bench, ["item_id"], "words").select("item_id", F.col("fp").alias("item_fp"), F.inline(blocks(F.col("fp"), radius)))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    close = a.join(b, ["block", "value"]).where(near).select("c1", "c2", "item_id")

    rarity = wanted.groupBy("shingle").agg(F.countDistinct("item_id").alias("items"))
    of_class = prefixes(classes, ["c1", "c2"], rarity, similarity)
    of_item = prefixes(bench, ["item_id"], rarity, similarity).withColumnRenamed("size", "item_size")
    alike = F.least("size", "item_size") >= similarity * F.greatest("size", "item_size") - 1e-6
    pairs = close.union(of_class.join(of_item, ["shingle", "copy"]).where(alike).select("c1", "c2", "item_id")).distinct()

    counted = lambda t, ids, n: t.select(*ids, F.explode("shingles").alias("shingle")).groupBy(*ids, "shingle").agg(F.count("*").alias(n))
    sizes = pairs.join(classes.select("c1", "c2", F.size("shingles").alias("size_c")), ["c1", "c2"]).join(bench.select("item_id", F.size("shingles").alias("size_i")), "item_id")
    common = sizes.join(counted(classes, ["c1", "c2"], "n_c"), ["c1", "c2"]).join(counted(bench, ["item_id"], "n_i"), ["item_id", "shingle"])
    least = common.groupBy("c1", "c2", "item_id", "size_c", "size_i").agg(F.sum(F.least("n_c", "n_i")).alias("least"))
    found = least.withColumn("similarity", F.col("least") / (F.col("size_c") + F.col("size_i") - F.col("least"))).where(F.col("similarity") >= similarity)
    return windows.join(found.select("c1", "c2", "item_id", "similarity"), ["c1", "c2"]).select(F.col("key").alias(key), "item_id", "start", "stop", "similarity")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """(key, item_ids, similarity) of the documents that hold an item: its ids in order and the highest similarity."""
    found = matches(docs, items, text, key, **more)
    best = found.groupBy(key, "item_id").agg(F.max("similarity").alias("similarity"))
    return best.groupBy(key).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
