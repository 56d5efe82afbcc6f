"""Signals and alternates as control rows: a row of data sees the last control row before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.errors import AlternateNotFoundError
from weir.functions.sequence import last_before


def signal_asof(df: DataFrame, order: str, is_signal: Column, payload: Column, name: str = "signal") -> DataFrame:
    """``df`` with the payload of the latest signal at or before each row."""
    return last_before(df, order, F.when(is_signal, payload), name)


def switched(df: DataFrame, ts: str, switches: list[tuple[object, str]], alternates: dict[str, Column], initial: str, name: str = "out") -> DataFrame:
    """``df`` with the active alternate's value; ``switches`` are (from when, alternate) and few, so they are an expression."""
    for _, a in [(None, initial), *switches]:
        if a not in alternates:
            raise AlternateNotFoundError(a)
    active = F.lit(initial)
    for when, a in sorted(switches, key=lambda s: s[0]):
        active = F.when(F.col(ts) >= F.lit(when), F.lit(a)).otherwise(active)
    value = None
    for a, c in alternates.items():
        value = F.when(F.col("active") == a, c) if value is None else value.when(F.col("active") == a, c)
    return df.withColumn("active", active).withColumn(name, value)
