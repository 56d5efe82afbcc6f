"""Stateful nodes on streams: keyed folds whose state is in Spark's state store and its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk, with change logs as deltas; needed by the stateful operators."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Fold(StatefulProcessor):
    """Keeps one value a key: ``step(state or None, row)`` gives the new state, a tuple; each row emits (key, order, state).

    Rows of a batch are folded in order of the ``order`` column. A state of None clears the key."""

    def __init__(self, state_schema: str, step: Callable[[tuple | None, Row], tuple | None], order: str, columns: list[str], teardown: Callable[[], None] | None = None):
        self.state_schema, self.step, self.order, self.columns, self.teardown = state_schema, step, order, columns, teardown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        now = tuple(self.state.get()) if self.state.exists() else None
        for row in sorted(rows, key=lambda r: r[self.order]):
            now = self.step(now, row)
            kept = now or (None,) * (len(self.columns) - 2)
            yield Row(**dict(zip(self.columns, (*key, row[self.order], *kept), strict=True)))
        if now is None:
            self.state.clear()
        else:
            self.state.update(now)

    def close(self) -> None:
        if self.teardown:
            self.teardown()


def fold(df: DataFrame, key: str, order: str, state_schema: str, step: Callable[[tuple | None, Row], tuple | None], teardown: Callable[[], None] | None = None) -> DataFrame:
    """The running fold of each key, on a stream or a table; state outlives restarts from the same checkpoint."""
    fields = StructType([df.schema[key], df.schema[order], *StructType.fromDDL(state_schema).fields])
    return df.groupBy(key).transformWithState(Fold(state_schema, step, order, fields.names, teardown), outputStructType=fields, outputMode="Append", timeMode="None")


def running_count(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, n): the count of each key after each row."""
    return fold(df, key, order, "n long", lambda s, r: ((s[0] if s else 0) + 1,))
