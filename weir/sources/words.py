"""Sources that cycle lists of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _cycled(words: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))


def words(spark: SparkSession, listed: list[str], n: int) -> DataFrame:
    """(id, word): the first ``n`` rows of the endless cycle."""
    return spark.range(n).select("id", _cycled(listed, F.col("id")).alias("word"))


def words_stream(spark: SparkSession, listed: list[str], rows_per_second: int = 1) -> DataFrame:
    """(id, word, timestamp): the cycle as a stream."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("id"), _cycled(listed, F.col("value")).alias("word"), "timestamp")


def two_streams(spark: SparkSession, first: str, second: str, first_words: list[str], second_words: list[str], n: int) -> DataFrame:
    """(id, _stream, word): rows alternate between two streams, each cycling its own words."""
    turn = F.floor(F.col("id") / 2)
    even = F.col("id") % 2 == 0
    word = F.when(even, _cycled(first_words, turn)).otherwise(_cycled(second_words, turn))
    return spark.range(n).select("id", F.when(even, F.lit(first)).otherwise(F.lit(second)).alias("_stream"), word.alias("word"))
