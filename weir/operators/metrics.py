"""Counts on edges: received, emitted and dropped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def edge_metrics(df: DataFrame, stream: Column, subscribers: dict[str, list[str]]) -> DataFrame:
    """(edge, received, emitted, dropped) of each subscriber's edge, in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("edge"), F.coalesce(stream.isin(*s), F.lit(False)).alias("took")) for k, s in subscribers.items()])
    rows = df.select(F.inline(cells))
    return rows.groupBy("edge").agg(F.count("*").alias("received"), F.count_if("took").alias("emitted"), F.count_if(~F.col("took")).alias("dropped"))


def observed(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, Observation]:
    """``df`` whose next action also fills the returned observation."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in (values or {"rows": F.count(F.lit(1))}).items()]), seen
