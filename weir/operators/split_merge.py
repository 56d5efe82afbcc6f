"""Duplicate and content-based splits, and merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def and_split(df: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], tag: str = "node") -> DataFrame:
    """Every branch sees every row. Row-wise branches are better given as ``and_split_rows``, which reads ``df`` once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f(df).withColumn(tag, F.lit(k)) for k, f in branches.items()])


def and_split_rows(df: DataFrame, branches: dict[str, Column], value: str, tag: str = "node") -> DataFrame:
    """Each row once for each branch with the branch's ``value``: one scan and no union."""
    cells = F.array(*[F.struct(F.lit(k).alias(tag), c.alias(value)) for k, c in branches.items()])
    return df.select("*", F.inline(cells))


def or_split(df: DataFrame, stream: Column, subscribers: dict[str, list[str]], tag: str = "node") -> DataFrame:
    """Each row goes to the subscribers of its stream; a stream that nobody takes is dropped."""
    cells = F.array(*[F.when(stream.isin(*s), F.lit(k)) for k, s in subscribers.items()])
    return df.select("*", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias(tag))
