"""What the operators share."""

import types

import pytest
from pyspark.sql import functions as F

from weir.llm import common


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "file:/w"}
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: conf.get(k) or d), sparkContext=types.SimpleNamespace(master=master))


def test_shared_folders():
    assert common.shared_dir(session("spark://h:1", "hdfs://h/c/"), "x").startswith("hdfs://h/c/x-")
    assert common.shared_dir(session("local[4]"), "x").startswith("file:/w/_shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://h:1"), "x")


def test_tables_are_saved_and_discarded(spark):
    before = spark.conf.get(common.FREE_SHUFFLES)
    df = common.saved(spark.range(10).withColumn("part", F.col("id") % 2).repartition(3), "numbers", by="part")
    assert df.count() == 10 and spark.conf.get(common.FREE_SHUFFLES) == before
    common.discard(df, "part=1")
    assert spark.read.parquet(df._saved_at).count() == 5
    common.discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(df._saved_at)


def test_buckets_follow_the_bytes_of_texts(spark, monkeypatch):
    df = spark.range(8).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert common.bucket_count(df) == 4 and common.bucket_count(df.where("false")) == 1
    monkeypatch.setattr(common, "LARGE_BUCKET", 1 << 20)
    assert common.bucket_count(df) == 8


def test_each_bucket_is_a_task(spark):
    df = spark.range(100).withColumn("bucket", (F.col("id") % 7).cast("int")).repartition(5)
    sums = lambda t: common.pa.table({"bucket": t.column("bucket").slice(0, 1), "n": [t.num_rows]})
    for deal in (common.per_bucket, common.grouped):
        got = {r.bucket: r.n for r in deal(df, 7, sums, "bucket int, n long").collect()}
        assert got == {k: len(range(k, 100, 7)) for k in range(7)}
