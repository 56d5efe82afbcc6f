"""Dispersion rules made visible: which instance a row goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.sequence import with_sequence


def round_robin(df: DataFrame, key: str, instances: int, name: str = "instance", turn: str | None = None) -> DataFrame:
    """Deal rows to ``instances`` in order of ``key``, starting with 0; ``turn``, if named, is how many rows the instance got before."""
    at = F.col("__seq") - 1
    dealt = {name: (at % instances).cast("int")}
    if turn:  # every instances-th row reaches an instance
        dealt[turn] = F.floor(at / instances)
    return with_sequence(df, key, "__seq").withColumns(dealt).drop("__seq")


def round_robin_two_level(df: DataFrame, key: str, workers: int, instances: int) -> DataFrame:
    """Deal to workers, and within a worker by a counter of its own to instances."""
    dealt = round_robin(df, key, workers, "worker", turn="__turn")
    return dealt.withColumn("instance", (F.col("__turn") % instances).cast("int")).drop("__turn")


def owner(ring: Column, h: Column) -> Column:
    """The worker that owns hash ``h`` on ``ring``, an array of (token, worker) in token order: the greatest token <= h, else the greatest of all."""
    below = F.filter(ring, lambda x: x["token"] <= h)
    found = F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.element_at(ring, -1))
    return found["worker"]


def ring_array(tokens: DataFrame) -> DataFrame:
    """One row with ``ring``, the (token, worker) array of a table of tokens; it has a row a worker, so it is small by nature."""
    return tokens.agg(F.array_sort(F.collect_list(F.struct(F.col("token").cast("bigint").alias("token"), "worker"))).alias("ring"))


def with_owner(df: DataFrame, tokens: DataFrame, h: Column, name: str = "worker") -> DataFrame:
    """``df`` with the owner of ``h``; the ring is one broadcast row."""
    return df.crossJoin(F.broadcast(ring_array(tokens))).withColumn(name, owner(F.col("ring"), h.cast("bigint"))).drop("ring")


def settled_ring(changes: DataFrame) -> DataFrame:
    """(token, worker) after all ``changes`` (seq, worker, token): a worker is where it last moved, and a newcomer evicts whoever held its token."""
    by_token = Window.partitionBy("token").orderBy(F.desc("seq"))
    by_worker = Window.partitionBy("worker").orderBy(F.desc("seq"))
    last = changes.withColumns({"t": F.row_number().over(by_token), "w": F.row_number().over(by_worker)})
    return last.where("t = 1 and w = 1").select("token", "worker")


def multicast(df: DataFrame, targets: Column, name: str = "target") -> DataFrame:
    """A copy of each row for each of its ``targets``; none means the row is dropped."""
    return df.withColumn(name, F.explode(targets))


def to_instances(df: DataFrame, instance: str, n: int) -> DataFrame:
    """Rows moved so that partition i holds the rows of instance i."""
    return df.repartitionById(n, F.col(instance).cast("int"))


def with_envelope(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_hash`` (standard murmur3 of the key) and ``_sent_at``: what a reduce edge sends along."""
    from weir.functions.murmur import murmur3

    return df.withColumns({"_hash": murmur3(F.col(key).cast("string")), "_sent_at": F.current_timestamp()})
