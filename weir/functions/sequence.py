"""Order without a single task: sequence numbers, running folds and last values over a numeric key.

A window without partitions would pull every row into one task. Here the rows are
cut into cells at quantiles of the key (a function of the key alone, so retries
agree, and an outlier moves no other row), each cell is ordered on its own, and
what came before a cell is a window over the small table of cells. Rows of equal
keys are ordered by a hash of all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a cell should hold, and how many cells there may be.
CELL_ROWS, MAX_CELLS = 100_000, 10_000


def bounds_of(df: DataFrame, key: str, cell_rows: int = CELL_ROWS) -> list[float]:
    """The quantiles of the key at which ``df`` is cut into cells, ascending."""
    cells = min(MAX_CELLS, df.count() // cell_rows)
    return sorted(set(df.approxQuantile(key, [k / cells for k in range(1, cells)], 0.2 / cells))) if cells > 1 else []


def cell_of(df: DataFrame, key: str, cell_rows: int = CELL_ROWS) -> Column:
    """The cell of each row of ``df``: how many quantiles of the key are at or below it; null keys are in cell -1, before all others."""
    return _cell(key, bounds_of(df, key, cell_rows))


def _cell(key: str, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` are at or below the key, by halving: a comparison for each binary digit of their number."""
    k = F.col(key).cast("double")
    if not bounds:
        return F.when(k.isNull(), -1).otherwise(0).cast("bigint")
    table = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= k, at + step).otherwise(at))
    # never null, and said so: else a join on the cell would search twice, once to filter
    return F.when(k.isNull(), -1).otherwise(F.coalesce(at, F.lit(0))).cast("bigint")


def _with_tie(df: DataFrame) -> DataFrame:
    """``df`` with ``__tie``, which orders rows of equal keys whatever their partitions."""
    return df.withColumn("__tie", F.xxhash64(*[c for c in df.columns if not c.startswith("__")]))


def _before(cells: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``cells`` with ``before``: ``value`` over the cells before each."""
    w = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    if by:
        w = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("__before", value.over(w))


def with_sequence(df: DataFrame, key: str, name: str = "seq", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in order of the numeric ``key``."""
    df = _with_tie(df).withColumn("__cell", cell_of(df, key, cell_rows))
    cells = _before(df.groupBy("__cell").agg(F.count("*").alias("__n")), [], F.sum("__n"))
    here = F.row_number().over(Window.partitionBy("__cell").orderBy(key, "__tie")).cast("bigint")
    numbered = df.withColumn("__here", here).join(F.broadcast(cells.select("__cell", "__before")), "__cell")
    return numbered.withColumn(name, F.col("__here") + F.coalesce("__before", F.lit(0))).drop("__cell", "__tie", "__here", "__before")


def running(df: DataFrame, by: str, key: str, total: str, name: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``name``: the sum of ``total`` over rows of equal ``by`` up to and with this one, in order of ``key``.

    The running fold of a sum-like state: whole cells are pre-aggregated, so a hot key is spread over its cells.
    In a struct a null ``by`` equals itself, so that the join finds rows where the window left them."""
    df = _with_tie(df).withColumns({"__cell": cell_of(df, key, cell_rows), "__by": F.struct(by)})
    cells = _before(df.groupBy("__by", "__cell").agg(F.sum(total).alias("__n")), ["__by"], F.sum("__n"))
    here = F.sum(total).over(Window.partitionBy("__by", "__cell").orderBy(key, "__tie").rowsBetween(Window.unboundedPreceding, 0))
    joined = df.withColumn("__here", here).join(cells.select("__by", "__cell", "__before"), ["__by", "__cell"])
    return joined.withColumn(name, F.col("__here") + F.coalesce("__before", F.lit(0))).drop("__cell", "__by", "__tie", "__here", "__before")


def last_before(df: DataFrame, key: str, value: Column, name: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` at or before each row, in order of ``key`` (as-of lookup)."""
    bounds = bounds_of(df, key, cell_rows)
    every = df.sparkSession.range(-1, len(bounds) + 1).withColumnRenamed("id", "__cell")
    df = _with_tie(df).withColumns({"__cell": _cell(key, bounds), "__value": value})
    lasts = df.where(F.col("__value").isNotNull()).groupBy("__cell").agg(F.max_by("__value", F.struct(key, "__tie")).alias("__last"))
    cells = _before(every.join(lasts, "__cell", "left"), [], F.last("__last", ignorenulls=True)).select("__cell", "__before")
    here = F.last("__value", ignorenulls=True).over(Window.partitionBy("__cell").orderBy(key, "__tie").rowsBetween(Window.unboundedPreceding, 0))
    joined = df.withColumn("__here", here).join(F.broadcast(cells), "__cell")
    return joined.withColumn(name, F.coalesce("__here", "__before")).drop("__cell", "__tie", "__value", "__here", "__before")
