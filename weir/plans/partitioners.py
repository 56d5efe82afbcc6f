"""Partitioners of custom edges, by name or as ``module:function``."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.errors import InvalidAppError
from weir.plans.graph import Partitioner

_NAMED: dict[str, Partitioner] = {}


def register(name: str, partitioner: Partitioner) -> None:
    _NAMED[name] = partitioner


def load(name: str) -> Partitioner:
    """A registered partitioner, or the function that ``module:function`` names."""
    if name in _NAMED:
        return _NAMED[name]
    module, _, function = name.partition(":")
    if not function:
        raise InvalidAppError(f"no partitioner {name}; there are {', '.join(sorted(_NAMED))}")
    return getattr(import_module(module), function)


def to_every_instance(df: DataFrame, instances: int) -> DataFrame:
    """A copy of each row for each instance, in column ``_instance``."""
    return df.withColumn("_instance", F.explode(F.sequence(F.lit(0), F.lit(instances - 1)))).repartitionById(instances, F.col("_instance"))


def balanced(df: DataFrame, instances: int) -> DataFrame:
    """Rows dealt evenly whatever their keys."""
    return df.repartition(instances)


register("every_instance", to_every_instance)
register("balanced", balanced)
