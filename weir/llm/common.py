"""What the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that one numpy step works on.
CHUNK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each computed once a row: later filters on them stay above, so none is computed again below."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def partitions(spark: SparkSession) -> int:
    """How many buckets packed rows are dealt to; follows the session's setting, which grows with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text that make a bucket of a large table, and the least that do where there are shuffle partitions to fill.
LARGE_BUCKET, SMALL_BUCKET = 64 << 20, 2 << 20


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """How many buckets the packed rows of ``docs`` are dealt to: by the bytes of its texts, so that a bucket does not grow with the input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // LARGE_BUCKET), min(partitions(docs.sparkSession), -(-total // SMALL_BUCKET)))


def per_bucket(rows: DataFrame, buckets: int, run: Callable[[pa.Table], pa.Table], schema, column: str = "bucket") -> DataFrame:
    """``run`` of all rows of each bucket together: a partition, and so a task, for every bucket, without a sort."""

    def task(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return rows.repartitionById(buckets, F.col(column)).mapInArrow(task, schema)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver share. On a local master only, the warehouse stands in for it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def grouped(rows: DataFrame, buckets: int, run: Callable[[pa.Table], pa.Table], schema, in_a_task: int = 4) -> DataFrame:
    """``run`` of all rows of each bucket together, a few small buckets one after another in a task."""
    return rows.repartition(max(1, -(-buckets // in_a_task)), "bucket").groupBy("bucket").applyInArrow(run, schema)


#: Spark's setting that removes a query's shuffle files when the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(df: DataFrame, part: str = "") -> None:
    """Delete what ``saved`` wrote for ``df``, or the files of one partition (``column=value``), when no later step reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df._saved_at}/{part}".rstrip("/"))  # the store may be any that Spark reads
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def saved(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder (partitioned ``by`` a column) and read again: lineage ends here, and shuffles that led to it are freed."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def chunks(batches: Iterator, text: str, limit: int = CHUNK_BYTES) -> Iterator:
    """Arrow batches cut so that each holds about ``limit`` bytes of text; a longer text stays whole, alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(text)
        ends = np.cumsum([0 if v is None else v for v in _byte_lengths(lengths)])
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def _byte_lengths(column) -> list:
    return pc.binary_length(column).to_pylist()
