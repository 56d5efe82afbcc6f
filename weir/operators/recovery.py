"""Recovery and elasticity rules as DataFrame functions: log trimming, replay, neighbours, ring moves, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.routing import with_owner

MIN_TOKEN, MAX_TOKEN = -(2**31), 2**31 - 1


def trimmed(log: DataFrame, checkpoints: DataFrame, key: str, ts: str) -> DataFrame:
    """Messages that a key's last checkpoint (``key``, ``saved_ts``) does not cover; keys without one keep all."""
    last = checkpoints.groupBy(key).agg(F.max("saved_ts").alias("saved_ts"))
    return log.join(last, key, "left").where(F.col("saved_ts").isNull() | (F.col(ts) > F.col("saved_ts"))).drop("saved_ts")


def replay(log: DataFrame, checkpoints: DataFrame, key: str, ts: str, name: str = "ordinal") -> DataFrame:
    """What is re-sent for each key, newest first."""
    return trimmed(log, checkpoints, key, ts).withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts))))


def neighbours(tokens: DataFrame, tolerance: int) -> DataFrame:
    """(worker, rank, neighbour): each worker's next lower tokens on the ring, wrapping. The ring has a row a worker."""
    ring = tokens.agg(F.sort_array(F.collect_list(F.struct(F.col("token").cast("bigint").alias("token"), "worker")), asc=False).alias("ring"))
    at = ring.select("ring", F.posexplode("ring").alias("i", "me"))
    rank = at.select("*", F.explode(F.sequence(F.lit(1), F.lit(tolerance))).alias("rank")).where(F.col("rank") < F.size("ring"))
    return rank.select(F.col("me.worker").alias("worker"), "rank", F.get("ring", (F.col("i") + F.col("rank")) % F.size("ring"))["worker"].alias("neighbour"))


def midpoint(mine: Column, neighbour: Column) -> Column:
    """The token that halves the arc between a worker and its lower neighbour; if the neighbour is above, the arc wraps."""
    mine, neighbour = mine.cast("bigint"), neighbour.cast("bigint")
    half = lambda c: F.floor(F.abs(c) / 2).cast("bigint") * F.signum(c).cast("bigint")  # noqa: E731  toward zero
    below, above = mine - MIN_TOKEN, F.lit(MAX_TOKEN) - neighbour
    dist = half(below) + half(above)
    wrapped = F.when(below >= dist, mine - dist).otherwise(F.lit(MAX_TOKEN) - (dist - below))
    return F.when(neighbour <= mine, mine - half(mine - neighbour)).otherwise(wrapped)


def moved_keys(df: DataFrame, before: DataFrame, after: DataFrame, h: Column) -> DataFrame:
    """``df`` with its owner on either ring, for the rows whose owner changes."""
    both = with_owner(with_owner(df, before, h, "old_worker"), after, h, "new_worker")
    return both.where(~F.col("old_worker").eqNullSafe(F.col("new_worker")))


def overloaded(queue: DataFrame, ts: str, length: str, window: str = "30 seconds", threshold: float = 10.0) -> DataFrame:
    """Windows of time whose 95th percentile queue length asks for help."""
    out = queue.groupBy(F.window(ts, window).alias("w")).agg(F.percentile(length, F.lit(0.95)).alias("p95"))
    return out.select(F.col("w.start").alias("start"), "p95", (F.col("p95") > threshold).alias("ask"))


def failed(checkpoints: DataFrame, worker: str, ts: str, period: str, now: Column, missed: int = 3) -> DataFrame:
    """(worker, last): workers whose last checkpoint is more than ``missed`` periods old."""
    last = checkpoints.groupBy(worker).agg(F.max(ts).alias("last"))
    return last.where(F.col("last") + F.expr(f"{missed} * INTERVAL {period}") < now)


def take_over(tokens: DataFrame, dead: str) -> DataFrame:
    """The ring after the dead worker's lower neighbour has moved to its token; alone on the ring, nobody takes over."""
    near = neighbours(tokens, 1).where(F.col("worker") == dead).select(F.col("neighbour").alias("heir"))
    place = tokens.where(F.col("worker") == dead).select(F.col("token").alias("dead_token"))
    alive = tokens.where(F.col("worker") != dead)
    moved = alive.join(F.broadcast(near), F.col("worker") == F.col("heir"), "left").join(F.broadcast(place))
    return moved.select("worker", F.when(F.col("heir").isNotNull(), F.col("dead_token")).otherwise(F.col("token")).alias("token"))


def state_ratio(deltas: DataFrame, key: str, ts: str, since: Column) -> DataFrame:
    """(full, delta, ratio): keys in all state, keys changed after ``since``, and their ratio."""
    per_key = deltas.groupBy(key).agg(F.max(ts).alias("last"))
    return per_key.agg(F.count("*").alias("full"), F.count_if(F.col("last") > since).alias("delta")).withColumn("ratio", F.col("delta") / F.col("full"))


def mapping_delta(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change): what to add, remove or move to get from one mapping to the other."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    change = F.when(F.col("old").isNull(), F.lit("add")).when(F.col("new").isNull(), F.lit("remove")).when(F.col("old") != F.col("new"), F.lit("move"))
    return both.withColumn("change", change).where(F.col("change").isNotNull())
