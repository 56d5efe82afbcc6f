import time

import pytest
from pyspark.sql import functions as F

from weir.errors import AlternateNotFoundError, AppNotFoundError, DuplicateError, InsufficientResourcesError, InvalidAppError, NodeNotFoundError
from weir.plans.graph import Graph
from weir.streaming import state
from weir.streaming.runtime import Engine, Status

ONCE = {"availableNow": True}


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "id long, word string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put("a", [(k, "abc"[k % 3]) for k in range(9)])
    return tmp_path, put


def stream(spark, path):
    return spark.readStream.schema("id long, word string").parquet(f"{path}/in")


def greeter():
    g = Graph("greeter")
    g.source("words", lambda s: s.createDataFrame([], "id long, word string"))
    n = g.dynamic_node("greet").subscribe("words")
    for a in ("Hello", "Welcome"):
        n.alternate(a.lower(), 1.0, lambda df, a=a: df.select("id", F.concat(F.lit(a + " "), "word").alias("out")))
    n.use("hello")
    g.node("loud", lambda df: df.select("id", F.upper("out").alias("out"))).subscribe("greet")
    g.node("plain", lambda df: df).subscribe("greet")
    return g


def test_app_switches_signals_and_restarts(spark, folder):
    path, put = folder
    engine, seen, signals, closed = Engine(spark), {"loud": [], "plain": []}, [], []
    sinks = {k: lambda df, i, k=k: seen[k].extend(r.out for r in df.collect()) for k in seen}
    run = lambda: engine.submit("app", greeter(), {"words": stream(spark, path)}, sinks, f"{path}/cp", ONCE, {"greet": signals.append}, {"greet": lambda: closed.append(1)})
    run()
    engine.wait("app")
    assert len(seen["plain"]) == 9 and sorted(seen["loud"])[0] == "HELLO A"
    assert engine.status("app") is Status.TERMINATED
    put("b", [(9, "z")])
    engine.switch_alternate("app", "greet", "welcome")
    engine.signal("app", "GREET", b"hi")
    assert engine.scale("app", "greet", 1) == 2
    run()  # goes on after what the checkpoint has
    engine.wait("app")
    assert seen["plain"][9:] == ["Welcome z"] and signals == [b"hi"]
    engine.kill("app")
    assert closed == [1] and engine.status("app") is Status.TERMINATED
    assert engine.ping("x") == "x"


def test_errors(spark, folder):
    path, _ = folder
    engine = Engine(spark)
    with pytest.raises(AppNotFoundError):
        engine.status("none")
    with pytest.raises(NodeNotFoundError):
        engine.submit("e", greeter(), {"nowhere": stream(spark, path)}, {"plain": print}, f"{path}/c1")
    with pytest.raises(InvalidAppError):
        engine.submit("e", greeter(), {}, {"plain": print}, f"{path}/c2")

    def fail(df, i):
        raise RuntimeError("sink failed")

    engine.submit("e", greeter(), {"words": stream(spark, path)}, {"plain": fail}, f"{path}/c3", ONCE)
    with pytest.raises(Exception, match="sink failed"):
        engine.wait("e")
    assert engine.status("e") is Status.FAILED
    engine.submit("e", greeter(), {"words": stream(spark, path)}, {"plain": lambda df, i: None}, f"{path}/c4", {"processingTime": "1 second"})
    with pytest.raises(DuplicateError):
        engine.submit("e", greeter(), {"words": stream(spark, path)}, {"plain": lambda df, i: None}, f"{path}/c5")
    with pytest.raises(AlternateNotFoundError):
        engine.switch_alternate("e", "greet", "bye")
    with pytest.raises(InsufficientResourcesError):
        engine.scale("e", "greet", 10_000)
    engine.kill("e")


def test_running_count_survives_restart_and_equals_batch(spark, folder):
    path, put = folder
    state.use_rocksdb(spark)
    out = []

    def run():
        df = state.running_count(stream(spark, path), "word", "id")
        q = df.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, i: out.extend((r.word, r.id, r.n) for r in b.collect())).trigger(**ONCE).start()
        q.awaitTermination()

    run()
    put("b", [(k, "abc"[k % 3]) for k in range(9, 15)])
    run()
    want = [("abc"[k % 3], k, k // 3 + 1) for k in range(15)]
    assert sorted(out) == sorted(want)
    batch = state.running_count(spark.read.parquet(f"{path}/in"), "word", "id")
    assert sorted((r.word, r.id, r.n) for r in batch.collect()) == sorted(want)


def test_feedback(spark, tmp_path):
    from weir.streaming.feedback import feedback

    seed = spark.createDataFrame([(k, 0) for k in range(4)], "instance int, data int")
    q = feedback(seed, lambda df: df.withColumn("data", F.col("data") + 1).where("data <= 3"), f"{tmp_path}/loop", f"{tmp_path}/cp", {"processingTime": "0 seconds"})
    for _ in range(200):
        if spark.read.parquet(f"{tmp_path}/loop").count() >= 16:
            break
        q.awaitTermination(0.2)
    q.stop()
    got = [(r.instance, r.data) for r in spark.read.parquet(f"{tmp_path}/loop").collect()]
    assert sorted(got) == [(i, d) for i in range(4) for d in range(4)]


def counter(word="count"):
    g = Graph("counter")
    g.source("words", lambda s: s.createDataFrame([], "id long, word string"))
    n = g.dynamic_node("mark").subscribe("words")
    n.alternate("plain", 1.0, lambda df: df)
    n.alternate("upper", 1.0, lambda df: df.withColumn("word", F.upper("word")))
    n.use("plain")
    g.node(word, lambda df: df.groupBy("word").agg(F.count("*").alias("n"))).reduce("mark", "word")
    return g


def test_reduce_nodes_count_on_over_batches_and_restarts(spark, folder):
    path, put = folder
    engine, seen = Engine(spark), {}
    sinks = {"count": lambda df, i: seen.update({r.word: r.n for r in df.collect()})}
    run = lambda: engine.submit("count", counter(), {"words": stream(spark, path)}, sinks, f"{path}/cp", ONCE)
    run()
    engine.wait("count")
    assert seen == {"a": 3, "b": 3, "c": 3}
    put("b", [(9, "a"), (10, "z")])
    run()
    engine.wait("count")
    assert seen == {"a": 4, "b": 3, "c": 3, "z": 1}
    put("c", [(11, "a")])
    engine.switch_alternate("count", "mark", "upper")
    run()
    engine.wait("count")
    assert seen["A"] == 1 and seen["a"] == 4
    g = counter()
    g.source("more", lambda s: s.createDataFrame([(1, "x")], "id long, word string"))
    g.nodes["count"].reduce("more", "word")
    with pytest.raises(InvalidAppError):
        engine.submit("mixed", g, {"words": stream(spark, path)}, sinks, f"{path}/cp2", ONCE)


def test_running_reduce_takes_a_switch(spark, folder):
    path, put = folder
    engine, seen = Engine(spark), {}
    engine.submit("live", counter(), {"words": stream(spark, path)}, {"count": lambda df, i: seen.update({r.word: r.n for r in df.collect()})}, f"{path}/live", {"processingTime": "0 seconds"})

    def until(ready):
        for _ in range(300):
            if ready():
                return
            time.sleep(0.1)
        raise AssertionError(seen)

    until(lambda: seen.get("a") == 3)
    engine.switch_alternate("live", "mark", "upper")
    put("b", [(20, "a")])
    until(lambda: seen.get("A") == 1)
    engine.kill("live")


def test_static_sources_come_whole_and_signals_reach_bodies(spark, folder):
    path, put = folder
    g = Graph("static")
    g.source("words", lambda s: s.createDataFrame([], "id long, word string"))
    g.source("table", lambda s: s.createDataFrame([(100, "t"), (101, "t")], "id long, word string"))
    g.node("all", lambda df, signal: df.withColumn("signal", F.lit(signal).cast("string"))).subscribe("words").subscribe("table")
    engine, seen = Engine(spark), []
    run = lambda: engine.submit("s", g, {"words": stream(spark, path)}, {"all": lambda df, i: seen.extend((r.word, r.signal) for r in df.collect())}, f"{path}/cp", ONCE)
    run()
    engine.wait("s")
    assert len(seen) == 11 and seen.count(("t", None)) == 2
    engine.signal("s", "all", "go")
    put("b", [(9, "z")])
    run()
    engine.wait("s")
    assert seen[11:] == [("z", "go")]


def test_control_from_another_process(spark, folder, tmp_path, capsys):
    from weir import cli

    path, put = folder
    control = f"{tmp_path}/control"
    engine, seen, signals = Engine(spark, control), [], []
    engine.submit("app", greeter(), {"words": stream(spark, path)}, {"plain": lambda df, i: seen.extend(r.out for r in df.collect())}, f"{path}/cp", ONCE, {"greet": signals.append})
    engine.wait("app")
    assert cli.main(["status", control, "app"]) == 0 and capsys.readouterr().out.strip() in ("RUNNING", "STARTING")
    assert cli.main(["switch", control, "app", "greet", "welcome"]) == cli.main(["signal", control, "app", "greet", "hi"]) == cli.main(["scale", control, "app", "greet", "1"]) == 0
    put("b", [(9, "z")])
    engine.poll("app")
    engine.submit("app", engine.apps["app"].graph, {"words": stream(spark, path)}, {"plain": lambda df, i: seen.extend(r.out for r in df.collect())}, f"{path}/cp", ONCE, {"greet": signals.append})
    engine.wait("app")
    assert seen[-1] == "Welcome z" and signals == ["hi"] and engine.apps["app"].graph.nodes["greet"].instances == 2
    engine.submit("app", engine.apps["app"].graph, {"words": stream(spark, path)}, {"plain": lambda df, i: None}, f"{path}/cp", {"processingTime": "1 second"})
    cli.main(["kill", control, "app"])
    engine.wait("app", 60)
    assert engine.status("app") is Status.TERMINATED and engine.control.reported("app") == "TERMINATED"
    assert cli.main(["status", control, "none"]) == 1
