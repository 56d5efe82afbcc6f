"""Feedback: a node that reads itself, for a bounded number of rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def counted_loop(spark: SparkSession, instances: int, rounds: int) -> DataFrame:
    """(instance, data): every value that ``instances`` counters pass when each round adds 1 to a seed of 0; one recursive query."""
    return spark.sql(f"""
        WITH RECURSIVE loop(instance, data) MAX RECURSION LEVEL {rounds + 1} AS (
          SELECT id, 0L FROM range({instances}) UNION ALL
          SELECT instance, data + 1 FROM loop WHERE data < {rounds})
        SELECT instance, data FROM loop""")


def iterate(seed: DataFrame, body: Callable[[DataFrame], DataFrame], rounds: int, cut_every: int = 10) -> DataFrame:
    """``body`` fed with its own output ``rounds`` times; lineage is cut by a checkpoint every ``cut_every`` rounds."""
    spark = seed.sparkSession
    if rounds > cut_every and not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    for k in range(1, rounds + 1):
        seed = body(seed)
        if k % cut_every == 0 and k < rounds:
            seed = seed.checkpoint()
    return seed
