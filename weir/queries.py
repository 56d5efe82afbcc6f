"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.murmur import murmur3
from weir.operators import control, loops, metrics, placement, recovery, routing, split_merge, state
from weir.plans.compile import run_batch
from weir.plans.graph import Graph
from weir.sources import words as word_sources
from weir.sources.tables import table
from weir.sources.text import pass_counts, replayed_counts, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FRUITS = ["quince", "fig", "medlar", "plum", "sloe"]
NORTH, SOUTH = ["bilberry", "rowan", "sloe"], ["olive", "carob"]
#: A ring of three workers, and the same after a fourth joins.
RING = [("A", -1_000_000_000), ("B", 0), ("C", 1_000_000_000)]
GROWN = [*RING, ("D", 500_000_000)]
#: Spreads small ids over the signed 32-bit range; the same arithmetic in SQL.
HASH = "(({0} * 2654435761) % 4294967296) - 2147483648"
SWITCH = "2024-01-02 00:00:00"

ORDERED = "(SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events)"
TOKENS = """SELECT trim(unnest(regexp_extract_all(text, '"[^"\\r\\n]*"?|[^\\x00-\\x20!"]+')), '"') AS word FROM documents"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _ring(spark: SparkSession, ring: list) -> DataFrame:
    return spark.createDataFrame(ring, "worker string, token long")


def _ring_sql(ring: list) -> str:
    return "(VALUES " + ", ".join(f"('{w}', {t}::BIGINT)" for w, t in ring) + ") AS r(worker, token)"


def _owner_sql(ring: list, h: str) -> str:
    r = _ring_sql(ring)
    return f"coalesce((SELECT arg_max(worker, token) FROM {r} WHERE token <= {h}), (SELECT arg_max(worker, token) FROM {r}))"


def _hash(c: str) -> Column:
    return F.expr(HASH.format(f"CAST({c} AS BIGINT)"))


# --- sources ---------------------------------------------------------------


@query("SELECT i AS id, ['quince', 'fig', 'medlar', 'plum', 'sloe'][i % 5 + 1] AS word FROM range(1000) t(i)")
def word_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_sources.words(spark, FRUITS, 1000)


@query("""
    SELECT i AS id, CASE WHEN i % 2 = 0 THEN 'north' ELSE 'south' END AS stream,
           CASE WHEN i % 2 = 0 THEN ['bilberry', 'rowan', 'sloe'][(i // 2) % 3 + 1] ELSE ['olive', 'carob'][(i // 2) % 2 + 1] END AS word
    FROM range(1000) t(i)""")
def two_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_sources.two_streams(spark, "north", "south", NORTH, SOUTH, 1000).withColumnRenamed("_stream", "stream")


@query(f"SELECT word, count(*)::BIGINT AS n FROM ({TOKENS}) GROUP BY word")
def file_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest([word, 'the', 'the']) AS word FROM ({TOKENS})) GROUP BY word")
def file_replay_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed_counts(file_tokens(spark, sf_dir))


# --- nodes -----------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events")
def linear_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph("linear")
    g.source("events", lambda s: table(s, sf_dir, "events"))
    g.node("print", lambda df: df.select("event_id", "user_id", "event_type", "value")).subscribe("events").parallelism(2)
    return run_batch(g, spark)["print"]


@query("SELECT event_id, value + 1 AS value FROM events")
def stateless_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") + 1).alias("value"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def filter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select("event_id", "user_id", "value")


@query("SELECT conv_id, turn, word, count(*)::BIGINT AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY ALL")
def flatmap_emit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    return rows.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))


# --- splits and merges -----------------------------------------------------


@query("""
    SELECT event_id, 'hello' AS node, 'Hello ' || event_type AS greeting FROM events
    UNION ALL SELECT event_id, 'welcome', 'Welcome ' || event_type FROM events""")
def and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = {"hello": F.concat(F.lit("Hello "), "event_type"), "welcome": F.concat(F.lit("Welcome "), "event_type")}
    return split_merge.and_split_rows(table(spark, sf_dir, "events"), branches, "greeting").select("event_id", "node", "greeting")


@query("SELECT event_id, 'on_' || event_type AS node FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def or_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    takers = {f"on_{t}": [t] for t in ("click", "view", "purchase")}
    return split_merge.or_split(table(spark, sf_dir, "events"), F.col("event_type"), takers).select("event_id", "node")


@query("""
    SELECT event_id, 'a' AS node FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, 'b' FROM events WHERE event_type IN ('view', 'click')""")
def or_split_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph("or_split")
    g.source("events", lambda s: table(s, sf_dir, "events").withColumn("_stream", F.col("event_type"))).emits("click", "view", "purchase", "signup", "error")
    g.node("a", lambda df: df.select("event_id", F.lit("a").alias("node"))).subscribe("events", "click")
    g.node("b", lambda df: df.select("event_id", F.lit("b").alias("node"))).subscribe("events", "view", "click")
    g.node("all", lambda df: df).subscribe("a").subscribe("b")
    return run_batch(g, spark)["all"]


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph("merge")
    g.source("customers", lambda s: table(s, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    g.source("suppliers", lambda s: table(s, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    g.node("all", lambda df: df).subscribe("customers").subscribe("suppliers")
    return run_batch(g, spark)["all"]


#: murmur3 of the eight digits of a number, as SQL: two words of four bytes, then the length.
MURMUR_SQL = """
    d AS (SELECT *, list_transform(string_split(digits, ''), lambda c: ascii(c)::HUGEINT) AS b FROM keys),
    k AS (SELECT *, (b[1] + b[2] * 256 + b[3] * 65536 + b[4] * 16777216) * 3432918353 % 4294967296 AS k1,
                    (b[5] + b[6] * 256 + b[7] * 65536 + b[8] * 16777216) * 3432918353 % 4294967296 AS k2 FROM d),
    r AS (SELECT *, (k1 * 32768 % 4294967296 + k1 // 131072) * 461845907 % 4294967296 AS x1, (k2 * 32768 % 4294967296 + k2 // 131072) * 461845907 % 4294967296 AS x2 FROM k),
    h1 AS (SELECT *, ((x1 * 8192 % 4294967296 + x1 // 524288) * 5 + 3864292196) % 4294967296 AS y1 FROM r),
    h2 AS (SELECT *, xor(y1, x2) AS z FROM h1),
    h3 AS (SELECT *, xor(((z * 8192 % 4294967296 + z // 524288) * 5 + 3864292196) % 4294967296, 8::HUGEINT) AS f FROM h2),
    f1 AS (SELECT *, xor(f, f // 65536) * 2246822507 % 4294967296 AS f_ FROM h3),
    f2 AS (SELECT *, xor(f_, f_ // 8192) * 3266489909 % 4294967296 AS f__ FROM f1),
    m AS (SELECT *, xor(f__, f__ // 65536) AS u FROM f2),
    hashed AS (SELECT *, (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END)::BIGINT AS h FROM m)"""


def _digits(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 8, "0")


@query(f"""
    WITH keys AS (SELECT s_name AS name, lpad(s_suppkey::VARCHAR, 8, '0') AS digits FROM supplier), {MURMUR_SQL}
    SELECT c_name AS name, ((row_number() OVER (ORDER BY c_custkey) - 1) % 2)::INT AS instance, NULL::INT AS hash FROM customer
    UNION ALL SELECT name, (((h % 2) + 2) % 2)::INT, h::INT FROM hashed""")
def merge_mixed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node that reads one predecessor round robin and another by key, whose envelope carries the key's murmur3."""
    g = Graph("mixed")
    g.source("customers", lambda s: table(s, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")))
    g.source("suppliers", lambda s: table(s, sf_dir, "supplier").select(_digits("s_suppkey").alias("key"), F.col("s_name").alias("name")))
    node = g.node("print", lambda df: df.select("name", F.coalesce("instance", F.pmod("_hash", F.lit(2))).cast("int").alias("instance"), F.col("_hash").alias("hash")))
    node.subscribe_with("customers", lambda df, n: routing.round_robin(df, "c_custkey", n))
    node.reduce("suppliers", "key", envelope=lambda df: routing.with_envelope(df, "key")).parallelism(2)
    return run_batch(g, spark)["print"]


# --- dispersion ------------------------------------------------------------


@query(f"SELECT ((rn - 1) % 3)::INT AS instance, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM {ORDERED} GROUP BY ALL")
def rr_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = routing.round_robin(table(spark, sf_dir, "events").select("event_id"), "event_id", 3)
    return dealt.groupBy("instance").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""
    SELECT event_id, worker, ((row_number() OVER (PARTITION BY worker ORDER BY event_id) - 1) % 2)::INT AS instance
    FROM (SELECT event_id, ((rn - 1) % 2)::INT AS worker FROM {ORDERED})""")
def rr_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.round_robin_two_level(table(spark, sf_dir, "events"), "event_id", 2, 2).select("event_id", "worker", "instance")


@query(f"SELECT event_id, {_owner_sql(RING, 'h')} AS worker FROM (SELECT event_id, {HASH.format('user_id')} AS h FROM events)")
def ring_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.with_owner(table(spark, sf_dir, "events"), _ring(spark, RING), _hash("user_id")).select("event_id", "worker")


@query(f"""
    WITH keys AS (SELECT DISTINCT user_id, lpad(user_id::VARCHAR, 8, '0') AS digits FROM events), {MURMUR_SQL}
    SELECT event_id, h::INT AS hash, {_owner_sql(RING, 'h')} AS worker FROM events JOIN hashed USING (user_id)""")
def ring_owner_murmur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner on the ring by the standard hash; each key is hashed once."""
    keys = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("hash", murmur3(_digits("user_id")))
    owned = routing.with_owner(keys, _ring(spark, RING), F.col("hash"))
    return table(spark, sf_dir, "events").join(owned, "user_id").select("event_id", "hash", "worker")


@query("""
    WITH c AS (SELECT event_id AS seq, 'w' || (user_id % 7) AS worker, (event_id * 31 % 11)::BIGINT AS token FROM events),
    r AS (SELECT token, worker, row_number() OVER (PARTITION BY token ORDER BY seq DESC) AS t, row_number() OVER (PARTITION BY worker ORDER BY seq DESC) AS w FROM c)
    SELECT token, worker FROM r WHERE t = 1 AND w = 1""")
def ring_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    changes = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("w"), F.col("user_id") % 7).alias("worker"), (F.col("event_id") * 31 % 11).alias("token"))
    return routing.settled_ring(changes)


@query("SELECT event_id, unnest(CASE WHEN event_type = 'error' THEN ['w0', 'w1', 'w2'] ELSE ['w' || (user_id % 3)] END) AS target FROM events")
def multicast(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array(F.lit("w0"), F.lit("w1"), F.lit("w2"))
    targets = F.when(F.col("event_type") == "error", every).otherwise(F.array(F.concat(F.lit("w"), F.col("user_id") % 3)))
    return routing.multicast(table(spark, sf_dir, "events"), targets).select("event_id", "target")


# --- reduction and state ---------------------------------------------------


@query(f"SELECT word, count(*)::BIGINT AS n FROM ({TOKENS}) GROUP BY word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph("word_count")
    g.source("words", lambda s: table(s, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")))
    g.node("count", lambda df: df.groupBy("word").agg(F.count("*").alias("n"))).reduce("words", "word")
    return run_batch(g, spark)["count"]


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS n FROM events")
def running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.running_count(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(f"SELECT event_id, instance, count(*) OVER (PARTITION BY instance ORDER BY event_id)::BIGINT AS n FROM (SELECT event_id, ((rn - 1) % 4)::INT AS instance FROM {ORDERED})")
def instance_scope_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.instance_running_count(table(spark, sf_dir, "events").select("event_id"), "event_id", 4)


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total, arg_max(value, event_id) AS last FROM events GROUP BY user_id")
def key_scope_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold_by_key(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("total", F.round("total", 4))


@query("SELECT user_id, event_type, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY ALL")
def state_delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merge_deltas(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts")


@query("SELECT user_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events WHERE ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY user_id")
def state_delta_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    return state.changed_since(e, ["user_id"], "value", "ts", F.lit(str(low + (high - low) / 2)).cast("timestamp_ntz"))


@query("""
    WITH s AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'b' WHEN event_id % 3 = 1 THEN 'f' ELSE 'd' END AS layer FROM events),
    l AS (SELECT layer, user_id, arg_max(value, event_id) AS value FROM s GROUP BY ALL)
    SELECT user_id, coalesce(max(value) FILTER (layer = 'd'), max(value) FILTER (layer = 'f'), max(value) FILTER (layer = 'b')) AS value FROM l GROUP BY user_id""")
def state_layered_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    layer = lambda k: state.merge_deltas(e.where(F.col("event_id") % 3 == k), ["user_id"], "value", "event_id")
    return state.layered_get(layer(0), layer(1), layer(2), "user_id", "value")


CHECKPOINTS = "(SELECT user_id, max(ts) AS saved_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id)"


def _log_and_checkpoints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("saved_ts"))


@query(f"SELECT event_id, user_id, ts FROM events LEFT JOIN {CHECKPOINTS} USING (user_id) WHERE saved_ts IS NULL OR ts > saved_ts")
def log_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.trimmed(*_log_and_checkpoints(spark, sf_dir), "user_id", "ts").select("event_id", "user_id", "ts")


@query(f"""
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC)::INT AS ordinal
    FROM events LEFT JOIN {CHECKPOINTS} USING (user_id) WHERE saved_ts IS NULL OR ts > saved_ts""")
def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.replay(*_log_and_checkpoints(spark, sf_dir), "user_id", "ts").select("event_id", "user_id", "ordinal")


# --- control ---------------------------------------------------------------


@query("SELECT event_id, 'Welcome ' || event_type AS greeting FROM events")
def alternate_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph("dynamic")
    g.source("events", lambda s: table(s, sf_dir, "events"))
    node = g.dynamic_node("greet").subscribe("events")
    for name, value in (("Hello", 1.0), ("Welcome", 0.5)):
        node.alternate(name.lower(), value, lambda df, n=name: df.select("event_id", F.concat(F.lit(f"{n} "), "event_type").alias("greeting")))
    node.use("welcome")
    return run_batch(g, spark)["greet"]


@query(f"SELECT event_id, CASE WHEN ts < TIMESTAMP '{SWITCH}' THEN 'hello' ELSE 'welcome' END AS active, CASE WHEN ts < TIMESTAMP '{SWITCH}' THEN 'Hello ' ELSE 'Welcome ' END || event_type AS greeting FROM events")
def alternate_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    alternates = {"hello": F.concat(F.lit("Hello "), "event_type"), "welcome": F.concat(F.lit("Welcome "), "event_type")}
    when = F.lit(SWITCH).cast("timestamp")
    out = control.switched(table(spark, sf_dir, "events").withColumn("__late", F.col("ts") >= when), "__late", [(True, "welcome")], alternates, "hello", "greeting")
    return out.select("event_id", "active", "greeting")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS signal FROM events")
def signal_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.signal_asof(table(spark, sf_dir, "events"), "event_id", F.col("event_type") == "error", F.col("event_id")).select("event_id", "signal")


@query("SELECT i AS instance, d AS data FROM range(4) a(i), range(51) b(d)")
def loop_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.counted_loop(spark, 4, 50)


@query("SELECT user_id, count(*)::BIGINT * 4 AS n, sum(event_id * 4 + 10)::BIGINT AS total FROM events GROUP BY user_id")
def loop_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node that reads itself for three rounds, and a reduce node that reads all rounds."""
    g = Graph("loop")
    g.source("events", lambda s: table(s, sf_dir, "events").select("user_id", F.col("event_id").alias("data")))
    g.node("loop", lambda df: df.withColumn("data", F.col("data") + 1)).subscribe("events").feedback("loop", 3)
    g.node("sums", lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("data").alias("total"))).reduce("loop", "user_id")
    return run_batch(g, spark)["sums"]


# --- elasticity ------------------------------------------------------------


@query("""
    SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, round(quantile_cont(value, 0.95), 6) AS p95, quantile_cont(value, 0.95) > 10 AS ask
    FROM events GROUP BY 1""")
def balance_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.overloaded(table(spark, sf_dir, "events"), "ts", "value", "1 hour").withColumn("p95", F.round("p95", 6))


@query("""
    WITH t AS (SELECT event_id, ((event_id * 2654435761) % 4294967296) - 2147483648 AS me, ((user_id * 2654435761) % 4294967296) - 2147483648 AS nb FROM events),
    d AS (SELECT *, me + 2147483648 AS below, (me + 2147483648) // 2 + (2147483647 - nb) // 2 AS dist FROM t)
    SELECT event_id, CASE WHEN nb <= me THEN me - (me - nb) // 2 WHEN below >= dist THEN me - dist ELSE 2147483647 - (dist - below) END::BIGINT AS token FROM d""")
def ring_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", recovery.midpoint(_hash("event_id"), _hash("user_id")).alias("token"))


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY token DESC) - 1 AS i, count(*) OVER () AS n FROM {_ring_sql(GROWN)})
    SELECT a.worker, k::INT AS rank, b.worker AS neighbour FROM r a, (VALUES (1), (2)) t(k) JOIN r b ON b.i = (a.i + k) % a.n""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.neighbours(_ring(spark, GROWN), 2)


@query(f"""
    SELECT * FROM (SELECT user_id, {_owner_sql(RING, 'h')} AS old_worker, {_owner_sql(GROWN, 'h')} AS new_worker
    FROM (SELECT DISTINCT user_id, {HASH.format('user_id')} AS h FROM events)) WHERE old_worker <> new_worker""")
def scale_moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return recovery.moved_keys(users, _ring(spark, RING), _ring(spark, GROWN), _hash("user_id"))


@query("""
    WITH c AS (SELECT s_nationkey AS nation, s_name AS container, (s_suppkey % 5 + 1)::INT AS cores, (s_suppkey % 4)::INT AS used FROM supplier),
    p AS (SELECT nation, container, row_number() OVER (PARTITION BY nation ORDER BY used DESC, container) AS k FROM c WHERE used < cores)
    SELECT n_nationkey AS nation, n_name AS name, container FROM nation LEFT JOIN p ON p.nation = n_nationkey AND k = 1""")
def placement_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    containers = s.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("container"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("cores"), (F.col("s_suppkey") % 4).cast("int").alias("used"))
    requests = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return placement.best_fit(requests, containers, "nation").select("nation", "name", "container")


@query("""
    WITH c AS (SELECT s_nationkey AS nation, s_name AS container, (s_suppkey % 5 + 1)::INT AS cores, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE (s_suppkey % 4)::INT END AS used FROM supplier),
    h AS (SELECT *, CASE WHEN used > 0 THEN ['AUTOMOBILE', 'BUILDING', 'FURNITURE'][used] END AS node FROM c),
    f AS (SELECT *, unnest(range(1, cores - used + 1)) AS core FROM h WHERE used < cores),
    own AS (SELECT *, row_number() OVER (PARTITION BY nation, node ORDER BY used DESC, container, core) AS instance FROM f WHERE node IS NOT NULL),
    emp AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY container, core) AS turn FROM f WHERE node IS NULL),
    r AS (SELECT c_nationkey AS nation, c_mktsegment AS node, unnest(range(1, count(*) % 4 + 2)) AS instance FROM customer GROUP BY c_nationkey, c_mktsegment),
    a AS (SELECT r.*, own.container AS mine FROM r LEFT JOIN own USING (nation, node, instance)),
    t AS (SELECT *, sum((mine IS NULL)::INT) OVER (PARTITION BY nation ORDER BY node, instance) AS turn FROM a)
    SELECT nation, t.node, t.instance::INT AS instance, coalesce(mine, emp.container) AS container
    FROM t LEFT JOIN emp USING (nation, turn)""")
def placement_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    used = F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(F.col("s_suppkey") % 4).cast("int")
    runs = F.get(F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE"])), F.col("used") - 1)
    containers = s.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("container"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("cores"), used.alias("used"))
    containers = containers.withColumn("node", F.when(F.col("used") > 0, runs))
    requests = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("node")).agg((F.count("*") % 4 + 1).cast("int").alias("instances"))
    return placement.place(requests, containers, "nation")


@query("""
    SELECT edge, count(*)::BIGINT AS received, count_if(took)::BIGINT AS emitted, count_if(NOT took)::BIGINT AS dropped FROM (
      SELECT 'a' AS edge, event_type = 'click' AS took FROM events UNION ALL SELECT 'b', event_type IN ('view', 'click') FROM events) GROUP BY edge""")
def edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_metrics(table(spark, sf_dir, "events"), F.col("event_type"), {"a": ["click"], "b": ["view", "click"]})


@query("""
    WITH w AS (SELECT 'w' || (user_id % 10) AS worker, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT worker, last FROM w WHERE last + 3 * INTERVAL '2 hours' < (SELECT max(ts) FROM events)""")
def failure_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    saved = e.where("event_type = 'purchase'").select(F.concat(F.lit("w"), F.col("user_id") % 10).alias("worker"), "ts")
    now = e.agg(F.max("ts")).first()[0]
    return recovery.failed(saved, "worker", "ts", "'2' HOUR", F.lit(str(now)).cast("timestamp_ntz"))


@query("SELECT worker, CASE WHEN worker = 'D' THEN 1000000000 ELSE token END::BIGINT AS token FROM " + _ring_sql(GROWN) + " WHERE worker <> 'C'")
def take_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.take_over(_ring(spark, GROWN), "C")


@query("""
    WITH k AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id),
    t AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half FROM events)
    SELECT count(*)::BIGINT AS "full", count_if(last > half)::BIGINT AS delta, count_if(last > half) / count(*) AS ratio FROM k, t""")
def state_size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    return recovery.state_ratio(e.where("event_type = 'signup'"), "user_id", "ts", F.lit(str(low + (high - low) / 2)).cast("timestamp_ntz"))


@query(f"""
    WITH u AS (SELECT user_id, {HASH.format('user_id')} AS h, bool_or(event_type = 'purchase') AS buys FROM events GROUP BY ALL),
    o AS (SELECT user_id, {_owner_sql(RING, 'h')} AS old FROM u), n AS (SELECT user_id, {_owner_sql(GROWN, 'h')} AS new FROM u WHERE buys)
    SELECT * FROM (SELECT user_id, old, new, CASE WHEN old IS NULL THEN 'add' WHEN new IS NULL THEN 'remove' WHEN old <> new THEN 'move' END AS change
    FROM o FULL JOIN n USING (user_id)) WHERE change IS NOT NULL""")
def mapping_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    buyers = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id").distinct()
    return recovery.mapping_delta(routing.with_owner(users, _ring(spark, RING), _hash("user_id")), routing.with_owner(buyers, _ring(spark, GROWN), _hash("user_id")), "user_id", "worker")


@query(f"""
    WITH t AS ({TOKENS}), n AS (SELECT count(*)::BIGINT AS n FROM documents)
    SELECT pass, word, sum(n)::BIGINT AS n FROM (
      SELECT 0 AS pass, word, count(*) AS n FROM t GROUP BY word
      UNION ALL SELECT p, w, count(*) FROM (SELECT p, unnest([word, 'the', 'the']) AS w FROM t, (VALUES (1), (2)) x(p)) GROUP BY ALL
      UNION ALL SELECT p, m, n FROM n, (VALUES (0, '0'), (0, '1'), (1, '1'), (1, '2'), (2, '2'), (2, '3')) x(p, m)) GROUP BY ALL""")
def file_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(file_tokens(spark, sf_dir), table(spark, sf_dir, "documents").agg(F.count("*").alias("n")), 3)


# --- beyond the graph layer: node bodies are DataFrames, so all of Spark SQL is there -------


@query("SELECT n_name AS nation, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def beyond_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def beyond_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)::INT AS place FROM customer QUALIFY place <= 3")
def beyond_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal")))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", place.alias("place")).where("place <= 3")


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def beyond_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def beyond_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT event_id, unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL '1 hour']) AS start FROM events")
def beyond_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "2 hours", "1 hour")
    return table(spark, sf_dir, "events").select("event_id", w.alias("w")).select("event_id", F.col("w.start").alias("start"))


@query("""
    WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true)::INT AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def beyond_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id")
def beyond_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's latest purchase at or before it: one shuffle by user, no pairs."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.last(bought, ignorenulls=True).over(w).alias("purchase"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def beyond_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def beyond_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT (props->>'k')::BIGINT AS n, count(*)::BIGINT AS events FROM events GROUP BY 1")
def beyond_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.get_json_object("props", "$.k").cast("bigint").alias("n")
    return table(spark, sf_dir, "events").groupBy(n).agg(F.count("*").alias("events"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def beyond_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition keeps its hundred, and those meet."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(100)
