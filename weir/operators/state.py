"""Keyed and per-instance state over bounded inputs, and its deltas.

State entries are rows (key, field, value, ts). The last write of a field wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.sequence import running
from weir.operators.routing import round_robin


def fold_by_key(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Count, sum and last value of each key: what a keyed reducer holds at the end."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max_by(value, order).alias("last"))


def running_count(df: DataFrame, key: str, order: str, name: str = "n") -> DataFrame:
    """What a counting reducer emits after each row."""
    return running(df.withColumn("__one", F.lit(1).cast("bigint")), key, order, "__one", name).drop("__one")


def instance_running_count(df: DataFrame, order: str, instances: int, name: str = "n") -> DataFrame:
    """The same with state scoped to the instance that a row is dealt to.

    Every ``instances``-th row reaches an instance, so its count is the quotient of the row's place."""
    return round_robin(df, order, instances, turn=name).withColumn(name, F.col(name) + 1)


def merge_deltas(deltas: DataFrame, by: list[str], value: str, ts: str) -> DataFrame:
    """The state after all deltas: last write wins for each of ``by``; independent of arrival order."""
    return deltas.groupBy(*by).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def changed_since(deltas: DataFrame, by: list[str], value: str, ts: str, since: Column) -> DataFrame:
    """What a checkpoint after ``since`` carries."""
    return merge_deltas(deltas.where(F.col(ts) > since), by, value, ts)


def layered_get(base: DataFrame, in_flight: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """Reads fall through: the current delta, then the one being checkpointed, then the base."""
    layers = [base.select(key, F.col(value).alias("b")), in_flight.select(key, F.col(value).alias("f")), delta.select(key, F.col(value).alias("d"))]
    out = layers[0].join(layers[1], key, "full").join(layers[2], key, "full")
    return out.select(key, F.coalesce("d", "f", "b").alias(value))
