import datetime as dt
import random
import re
from functools import partial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.functions.murmur import murmur3, murmur3_array
from weir.functions.retry import retry
from weir.functions.sequence import last_before, running, with_sequence
from weir.operators import loops, recovery, routing, state
from weir.sources.text import tokens

RING = [("A", -1_000_000_000), ("B", 0), ("C", 1_000_000_000)]


def plain_murmur3(data):
    """The public definition, byte by byte."""
    low = 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> (32 - r)) & low
    h = 0
    for k in range(0, len(data), 4):
        part = data[k : k + 4]
        x = rot(int.from_bytes(part, "little") * 0xCC9E2D51 & low, 15) * 0x1B873593 & low
        h ^= x
        if len(part) == 4:
            h = (rot(h, 13) * 5 + 0xE6546B64) & low
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & low
    h = (h ^ h >> 13) * 0xC2B2AE35 & low
    h ^= h >> 16
    return h - (h >> 31 << 32)


def test_murmur_vectors(spark):
    known = {"hello": 613153351, "": 0} | {w: plain_murmur3(w.encode()) for w in ("quince", "fig", "é", "medlars and plums", "a" * 31)}
    assert dict(zip(known, murmur3_array([k.encode() for k in known]).tolist())) == known
    got = spark.createDataFrame([(k,) for k in known] + [(None,)], "w string").select("w", murmur3("w").alias("h")).collect()
    assert {r.w: r.h for r in got} == known | {None: None}


def test_ring_owner(spark):
    ring = spark.createDataFrame(RING, "worker string, token long")
    wanted = {-2_000_000_000: "C", -1_000_000_000: "A", -1: "A", 0: "B", 999_999_999: "B", 2_147_483_647: "C"}
    hs = spark.createDataFrame([(h,) for h in wanted], "h long")
    assert {r.h: r.worker for r in routing.with_owner(hs, ring, F.col("h")).collect()} == wanted


@settings(max_examples=5, deadline=None)
@given(tokens=st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=6, unique=True), hs=st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=20))
def test_every_hash_has_one_owner(spark, tokens, hs):
    ring = spark.createDataFrame([(f"w{t}", t) for t in tokens], "worker string, token long")
    got = routing.with_owner(spark.createDataFrame([(h,) for h in hs], "h long"), ring, F.col("h")).collect()
    assert len(got) == len(hs)
    for r in got:
        below = [t for t in tokens if t <= r.h]
        assert r.worker == f"w{max(below or tokens)}"


def test_new_worker_takes_only_its_arc(spark):
    keys = spark.range(2000).select((F.col("id") * 2147483 - 2147483648).alias("h"))
    old, new = (spark.createDataFrame(r, "worker string, token long") for r in (RING, [*RING, ("D", 500_000_000)]))
    moved = recovery.moved_keys(keys, old, new, F.col("h")).collect()
    assert moved and {(r.old_worker, r.new_worker) for r in moved} == {("B", "D")}


def test_ring_changes_evict(spark):
    changes = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, "c", 5), (4, "b", 9)], "seq long, worker string, token long")
    assert {(r.token, r.worker) for r in routing.settled_ring(changes).collect()} == {(5, "c"), (9, "b")}


def test_midpoints(spark):
    cases = [(0, -1_000_000_000), (7, 2), (-2_000_000_000, 2_000_000_000), (2_000_000_000, 2_100_000_000)]
    got = spark.createDataFrame(cases, "me long, nb long").select("me", "nb", recovery.midpoint(F.col("me"), F.col("nb")).alias("m")).collect()
    low, high = -(2**31), 2**31 - 1
    for r in got:
        if r.nb <= r.me:
            want = r.me - (r.me - r.nb) // 2
        else:
            dist = (r.me - low) // 2 + (high - r.nb) // 2
            want = r.me - dist if r.me - low >= dist else high - (dist - (r.me - low))
        assert r.m == want
    assert got[0].m == -500_000_000


def test_multicast_and_instances(spark):
    df = spark.range(6).withColumn("to", F.when(F.col("id") == 0, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array((F.col("id") % 3).cast("int"))))
    out = routing.multicast(df, F.col("to"), "instance")
    assert out.count() == 8
    placed = routing.to_instances(out, "instance", 3).select("instance", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(r.instance == r.p for r in placed)


def test_sequences_over_many_cells(spark):
    ids = random.Random(1).sample(range(100_000), 500)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id long, k long").repartition(4)
    got = {r.id: r.seq for r in with_sequence(df, "id", cell_rows=20).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids), 1)}
    counts, want = {}, {}
    for i in sorted(ids):
        counts[i % 3] = want[i] = counts.get(i % 3, 0) + 1
    one = df.withColumn("one", F.lit(1).cast("long"))
    assert {r.id: r.n for r in running(one, "k", "id", "one", "n", cell_rows=20).collect()} == want
    last, asof = None, {}
    for i in sorted(ids):
        last = i if i % 7 == 0 else last
        asof[i] = last
    assert {r.id: r.s for r in last_before(df, "id", F.when(F.col("id") % 7 == 0, F.col("id")), "s", cell_rows=20).collect()} == asof


def test_outliers_and_ties_move_no_other_row(spark):
    """One key far away leaves the cells of the others as they are; equal keys are in one order whatever the partitions."""
    from weir.functions.sequence import cell_of

    df = spark.range(2000).union(spark.createDataFrame([(10**15,), (-(10**15),)], "id long"))
    sizes = [r["count"] for r in df.groupBy(cell_of(df, "id", 50).alias("c")).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 3 * 50
    assert {r.id: r.seq for r in with_sequence(df, "id", cell_rows=50).collect()} == {i: n for n, i in enumerate([-(10**15), *range(2000), 10**15], 1)}
    ties = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    orders = [{r.id: r.seq for r in with_sequence(ties.repartition(n), "k", cell_rows=20).collect()} for n in (1, 5)]
    assert orders[0] == orders[1] and sorted(orders[0].values()) == list(range(1, 301))


def test_search_for_a_cell_takes_few_steps(spark):
    """A row compares its key with a few of the bounds, however many there are."""
    import time

    from weir.functions import sequence

    def took(width):
        began = time.perf_counter()
        cell = sequence._cell("id", [float(k) for k in range(width, 150_000, width)])
        assert spark.range(150_000, numPartitions=4).where(cell != F.floor(F.col("id") / width)).count() == 0
        return time.perf_counter() - began

    few = took(20_000)
    assert took(100) < 5 + 20 * few


def test_instance_counts_follow_the_deal(spark):
    """The count of an instance is that of the rows dealt to it before, also among equal keys."""
    ties = spark.range(300).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    seq = {r.id: r.seq for r in with_sequence(ties, "k").collect()}
    assert {r.id: (r.n - 1) * 4 + r.instance + 1 for r in state.instance_running_count(ties, "k", 4).collect()} == seq


def seconds_over_cells(monkeypatch, deal, rows=150_000):
    """Seconds of ``deal`` with its rows in 7 cells and in 1,500."""
    import time

    took = []
    for cell_rows in (rows // 7, rows // 1500):
        monkeypatch.setattr(routing, "with_sequence", partial(with_sequence, cell_rows=cell_rows))
        began = time.perf_counter()
        deal(rows)
        took.append(time.perf_counter() - began)
    return took


def test_two_level_deal_over_many_cells(spark, monkeypatch):
    def deal(n):
        dealt = routing.round_robin_two_level(spark.range(n), "id", 2, 2)
        assert dealt.where((F.col("worker") != F.col("id") % 2) | (F.col("instance") != F.floor(F.col("id") / 2) % 2)).count() == 0

    few, many = seconds_over_cells(monkeypatch, deal)
    assert many < 10 + 10 * few


def test_last_value_among_equal_and_null_keys_reaches_later_cells(spark):
    """A later cell sees the value that is last in the order of the rows before it, ties and null keys included."""
    ties = spark.range(400).select(F.floor(F.col("id") / 40).alias("k"), "id").repartition(3)
    seq = {r.id: r.seq for r in with_sequence(ties, "k", cell_rows=40).collect()}
    got = last_before(ties, "k", F.when(F.col("k") % 3 == 0, F.col("id")), "s", cell_rows=40).collect()
    last, want = None, {}
    for i in sorted(seq, key=seq.get):
        last = want[i] = i if i // 40 % 3 == 0 else last
    assert {r.id: r.s for r in got} == want
    nulls = spark.range(200).union(spark.createDataFrame([(None,)], "id long"))
    signal = last_before(nulls, "id", F.when(F.col("id").isNull(), F.lit("first")), "s", cell_rows=20)
    assert [r.s for r in signal.distinct().select("s").distinct().collect()] == ["first"]


def moved(df, capsys):
    """What each exchange of the plan moves, as explained."""
    df.explain("formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", capsys.readouterr().out)


def wide(spark):
    return spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.lit("x" * 50).alias("payload"), F.rand(1).alias("noise"))


def test_running_folds_move_rows_once(spark, capsys):
    """Rows are moved to their cell and not again to what came before it; a null key counts on its own."""
    df = wide(spark).select("id", F.when(F.col("k") > 0, F.col("k")).alias("k"), "noise")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        counted = state.running_count(df, "k", "id")
        assert len([m for m in moved(counted, capsys) if "noise" in m]) == 1
        assert {r.id: r.n for r in counted.collect()} == {i: i // 3 + 1 for i in range(500)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dispersion_over_many_cells(spark, monkeypatch):
    def deal(n):
        dealt = routing.round_robin(spark.range(n), "id", 3).groupBy("instance").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
        assert {r.instance: (r.n, r.ids) for r in dealt.collect()} == {k: (len(range(k, n, 3)), sum(range(k, n, 3))) for k in range(3)}

    few, many = seconds_over_cells(monkeypatch, deal)
    assert many < 10 + 10 * few


def test_sequence_of_nothing(spark):
    assert with_sequence(spark.range(0), "id").collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([('hello "big world" a!b',), ('x "open\ny',), ("",), (None,)], "t string")
    assert [r.w for r in df.select(tokens(F.col("t")).alias("w")).collect()] == [["hello", "big world", "a", "b"], ["x", "open", "y"], [], None]


def test_state_merge_ignores_order(spark):
    rows = [(k % 3, "f", k, k) for k in range(30)]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        out = state.merge_deltas(spark.createDataFrame(rows, "key long, field string, value long, ts long"), ["key", "field"], "value", "ts")
        assert {r.key: r.value for r in out.collect()} == {0: 27, 1: 28, 2: 29}


def test_log_trim_is_per_key(spark):
    log = spark.createDataFrame([(1, 1), (1, 5), (2, 1), (2, 2), (3, 1)], "key long, ts long")
    saved = spark.createDataFrame([(1, 4), (2, 1), (1, 2)], "key long, saved_ts long")
    assert {(r.key, r.ts) for r in recovery.trimmed(log, saved, "key", "ts").collect()} == {(1, 5), (2, 2), (3, 1)}
    assert [(r.ts, r.ordinal) for r in recovery.replay(log, saved.where("false"), "key", "ts").where("key = 1").orderBy("ordinal").collect()] == [(5, 1), (1, 2)]


def test_overload_window(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(seconds=s), float(20 if s < 30 else 1)) for s in range(60)]
    got = recovery.overloaded(spark.createDataFrame(rows, "ts timestamp, q double"), "ts", "q").orderBy("start").collect()
    assert [r.ask for r in got] == [True, False]


def test_loops(spark):
    assert loops.counted_loop(spark, 4, 120).groupBy("instance").agg(F.max("data").alias("m")).where("m = 120").count() == 4
    out = loops.iterate(spark.range(4).withColumn("data", F.lit(0)), lambda df: df.withColumn("data", F.col("data") + 1), 25)
    assert [r.data for r in out.collect()] == [25] * 4


def test_retry_raises_when_used_up():
    calls = []

    def fail():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        retry(fail, tries=3, sleep_s=0)
    assert len(calls) == 3


def test_take_over_and_neighbours(spark):
    ring = spark.createDataFrame(RING, "worker string, token long")
    assert {(r.worker, r.token) for r in recovery.take_over(ring, "A").collect()} == {("C", -1_000_000_000), ("B", 0)}
    alone = spark.createDataFrame([("A", 5)], "worker string, token long")
    assert recovery.take_over(alone, "A").collect() == [] and recovery.neighbours(alone, 2).collect() == []
    assert {(r.worker, r.rank, r.neighbour) for r in recovery.neighbours(ring, 5).collect()} >= {("A", 1, "C"), ("B", 2, "C")}


def test_file_passes(spark):
    from weir.sources.text import passes

    df = spark.createDataFrame([("a b",)], "t string").select(F.inline(passes(F.col("t"), 7)))
    got = [(r["pass"], r.word) for r in df.collect()]
    assert got[:4] == [(0, "0"), (0, "a"), (0, "b"), (0, "1")]
    assert [w for k, w in got if k == 1] == ["1", "a", "the", "the", "b", "the", "the", "2"]
    assert [w for k, w in got if k == 6][0] == "0"


def test_counts_of_passes(spark):
    """Counts made from those of the plain tokens are those of the passes written out, null and empty texts and words like markers included."""
    from weir.sources.text import pass_counts, passes

    df = spark.createDataFrame([('a b the "c d"',), ("1 2 the a",), ("",), (None,)], "t string")
    counts = df.select(F.explode(tokens(F.col("t"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    for n in (1, 3, 8):
        got = pass_counts(counts, df.agg(F.count("*").alias("n")), n).collect()
        want = df.select(F.inline(passes(F.col("t"), n))).groupBy("pass", "word").agg(F.count("*").alias("n")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        assert [r.n for r in got if (r["pass"], r.word) == (0, "0")] == [4]


def test_partitioners(spark):
    from weir.errors import InvalidAppError
    from weir.plans import partitioners

    out = partitioners.load("every_instance")(spark.range(3), 2)
    assert out.count() == 6 and {(r._instance, r.p) for r in out.select("_instance", F.spark_partition_id().alias("p")).collect()} == {(0, 0), (1, 1)}
    assert partitioners.load("weir.plans.partitioners:balanced")(spark.range(3), 2).count() == 3
    with pytest.raises(InvalidAppError):
        partitioners.load("none")


def test_envelope(spark):
    row = routing.with_envelope(spark.createDataFrame([("hello",)], "w string"), "w").first()
    assert row._hash == 613153351 and row._sent_at is not None


def test_cli(spark, tmp_path, capsys):
    from weir import cli

    (tmp_path / "g.py").write_text(
        "from weir.plans.graph import Graph\n"
        "def build(spark):\n"
        "    g = Graph()\n"
        "    g.source('n', lambda s: s.range(3))\n"
        "    d = g.dynamic_node('out').subscribe('n')\n"
        "    for k in (1, 2):\n"
        "        d.alternate(str(k), 1.0, lambda df, k=k: df.selectExpr(f'id * {k} AS id'))\n"
        "    return g\n"
    )
    assert cli.main(["queries"]) == 0 and cli.main(["version"]) == 0
    assert cli.main(["run", f"{tmp_path}/g.py"]) == 1
    assert cli.main(["run", f"{tmp_path}/g.py", "--alternate", "out=9"]) == 1
    assert "AlternateNotFoundError" in capsys.readouterr().out
    assert cli.main(["run", f"{tmp_path}/g.py", "--alternate", "out=2", "--scale", "out=2", "--out", f"{tmp_path}/o"]) == 0
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/o/out").collect()) == [0, 2, 4]
