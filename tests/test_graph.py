import pytest
from pyspark.sql import functions as F

from weir.errors import AlternateNotFoundError, DuplicateError, InvalidAppError, NodeNotFoundError
from weir.operators.placement import place
from weir.plans.compile import run_batch
from weir.plans.graph import Graph
from weir.sources.words import two_streams, words


def greeting(word):
    return lambda df: df.select(F.concat(F.lit(word + " "), "word").alias("out"))


def rows(df, c="out"):
    return sorted(r[c] for r in df.select(c).collect())


def test_linear(spark):
    g = Graph()
    g.source("words", lambda s: words(s, ["quince", "fig", "medlar", "plum"], 8))
    g.node("print", lambda df: df).subscribe("words").parallelism(2)
    assert rows(run_batch(g, spark)["print"], "word") == sorted(["quince", "fig", "medlar", "plum"] * 2)


def test_and_split(spark):
    g = Graph()
    g.source("names", lambda s: words(s, list("01234"), 5))
    g.node("hello", greeting("Hello")).subscribe("names")
    g.node("welcome", greeting("Welcome")).subscribe("names")
    out = run_batch(g, spark)
    assert rows(out["hello"]) == [f"Hello {k}" for k in range(5)]
    assert rows(out["welcome"]) == [f"Welcome {k}" for k in range(5)]


def two(s):
    return two_streams(s, "north", "south", ["bilberry", "rowan", "sloe", "haw", "juniper"], ["olive", "carob", "fig", "almond", "lemon"], 10)


def test_or_split_takes_exact_streams(spark):
    g = Graph()
    g.source("names", two).emits("north", "south")
    g.node("hello", greeting("Hello")).subscribe("names", "north")
    g.node("welcome", greeting("Welcome")).subscribe("names", "south", "north")
    out = run_batch(g, spark)
    assert len(rows(out["hello"])) == 5
    assert len(rows(out["welcome"])) == 10


def test_merge_with_mixed_edges(spark):
    g = Graph()
    g.source("north", lambda s: words(s, ["rowan", "sloe", "haw"], 3))
    g.source("south", lambda s: words(s, ["olive", "fig", "carob"], 3))
    g.node("print", lambda df: df.withColumn("p", F.spark_partition_id())).subscribe("north").reduce("south", "word").parallelism(2)
    out = run_batch(g, spark)["print"].collect()
    assert sorted(r.word for r in out) == ["carob", "fig", "haw", "olive", "rowan", "sloe"]


def test_merge_fills_absent_fields(spark):
    g = Graph()
    g.source("a", lambda s: s.range(1).withColumn("x", F.lit(1)))
    g.source("b", lambda s: s.range(1).withColumn("y", F.lit(2)))
    g.node("all", lambda df: df).subscribe("a").subscribe("b")
    assert {(r.x, r.y) for r in run_batch(g, spark)["all"].collect()} == {(1, None), (None, 2)}


def test_parallel_edges_are_kept(spark):
    g = Graph()
    g.source("names", two).emits("north", "south")
    g.node("all", lambda df: df).subscribe("names", "north").subscribe("names", "north")
    assert run_batch(g, spark)["all"].count() == 10


def test_dynamic_node(spark):
    g = Graph()
    g.source("words", lambda s: words(s, ["quince", "fig", "medlar", "plum"], 4))
    node = g.dynamic_node("greet").subscribe("words").alternate("hello", 1.0, greeting("Hello")).alternate("welcome", 0.5, greeting("Welcome"))
    with pytest.raises(InvalidAppError):
        run_batch(g, spark)
    with pytest.raises(AlternateNotFoundError):
        node.use("bye")
    node.use("welcome")
    assert rows(run_batch(g, spark)["greet"]) == ["Welcome fig", "Welcome medlar", "Welcome plum", "Welcome quince"]
    node.use("hello")
    assert rows(run_batch(g, spark)["greet"])[0] == "Hello fig"


def test_word_count_on_a_reduce_edge(spark):
    g = Graph()
    g.source("words", lambda s: words(s, ["quince", "fig", "medlar", "plum", "sloe"], 15))
    g.node("count", lambda df: df.groupBy("word").count()).reduce("words", "word").parallelism(2)
    assert {r["count"] for r in run_batch(g, spark)["count"].collect()} == {3}


def test_custom_partitioner(spark):
    g = Graph()
    g.source("words", lambda s: words(s, ["a", "b"], 4))
    twice = lambda df, n: df.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    g.node("all", lambda df: df).subscribe_with("words", twice).parallelism(3)
    assert run_batch(g, spark)["all"].count() == 12


def test_feedback_edges(spark):
    """Four counters that read themselves, and a cycle of two nodes with a reader beside it."""
    g = Graph()
    g.source("seed", lambda s: s.range(4).select(F.col("id").alias("instance"), F.lit(0).alias("data")))
    g.node("loop", lambda df: df.withColumn("data", F.col("data") + 1)).subscribe("seed").feedback("loop", 3)
    g.node("sums", lambda df: df.groupBy("instance").agg(F.count("*").alias("n"), F.sum("data").alias("total"))).reduce("loop", "instance")
    out = run_batch(g, spark)
    assert {(r.instance, r.n, r.total) for r in out["sums"].collect()} == {(i, 4, 10) for i in range(4)}
    g = Graph()
    g.source("seed", lambda s: s.range(1))
    g.node("a", lambda df: df.withColumn("id", F.col("id") + 1)).subscribe("seed").feedback("b", 2)
    g.node("b", lambda df: df.withColumn("id", F.col("id") * 10)).subscribe("a")
    g.node("seen", lambda df: df).subscribe("a")
    assert set(g.sinks()) == {"seen", "b"}
    out = run_batch(g, spark)
    assert sorted(r.id for r in out["seen"].collect()) == [1, 11, 111]
    with pytest.raises(InvalidAppError):
        g.nodes["a"].feedback("a", 0)
    g.nodes["a"].feedback("seed", 1)
    with pytest.raises(InvalidAppError):
        run_batch(g, spark)


def test_envelopes_travel_with_an_edge(spark):
    from weir.operators.routing import with_envelope

    g = Graph()
    g.source("words", lambda s: words(s, ["fig", "plum"], 4))
    g.node("all", lambda df: df).reduce("words", "word", envelope=lambda df: with_envelope(df, "word")).parallelism(2)
    assert {(r.word, r._hash) for r in run_batch(g, spark)["all"].collect()} == {("fig", 923101995), ("plum", 191146971)}


def test_errors(spark):
    g = Graph()
    with pytest.raises(InvalidAppError):
        g.validate()
    g.source("a", lambda s: s.range(1))
    with pytest.raises(DuplicateError):
        g.source("a", lambda s: s.range(1))
    with pytest.raises(NodeNotFoundError):
        g.node("b", lambda df: df).subscribe("nowhere")
    with pytest.raises(InvalidAppError):
        g.nodes["b"].subscribe("a", "no_such_stream")
    with pytest.raises(InvalidAppError):
        g.validate()
    g.nodes["b"].subscribe("a")
    g.node("c", lambda df: df).subscribe("b")
    g.nodes["b"].subscribe("c")
    with pytest.raises(InvalidAppError):
        g.order()


def test_placement(spark):
    """A node's own containers first, the fullest before others; then empty ones; null when cores are used up."""
    containers = spark.createDataFrame([(1, "x", 2, 0, None), (1, "y", 3, 2, "a"), (1, "z", 3, 1, "a"), (1, "w", 2, 1, "b"), (1, "full", 1, 1, "a")], "k int, container string, cores int, used int, node string")
    requests = spark.createDataFrame([(1, "a", 4), (1, "b", 3), (2, "a", 1)], "k int, node string, instances int")
    got = {(r.k, r.node, r.instance): r.container for r in place(requests, containers, "k").collect()}
    assert got == {(1, "a", 1): "y", (1, "a", 2): "z", (1, "a", 3): "z", (1, "a", 4): "x", (1, "b", 1): "w", (1, "b", 2): "x", (1, "b", 3): None, (2, "a", 1): None}
