"""Best-fit placement: the fullest container that still has a free core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_fit(requests: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """For each ``key`` of ``requests``, the container (container, cores, used) of its ``key`` with most used cores among those with a free one, ties to the smaller name; null if all are full."""
    free = containers.where(F.col("used") < F.col("cores"))
    pick = free.groupBy(key).agg(F.min(F.struct((-F.col("used")).alias("k"), "container"))["container"].alias("container"))
    return requests.join(pick, key, "left")


def place(requests: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """(key, node, instance, container): instances 1, 2, ... of each (key, node, instances) of ``requests`` on free cores of ``containers`` (key, container, cores, used, node).

    A container that runs a node (``node``) takes only that node's instances, and those go there first, to the
    fullest one while it has a core left (ties to the smaller name). What is over goes, node after node, to
    containers that run nothing, one filled after another. The container is null where cores are used up."""
    free = containers.where(F.col("used") < F.col("cores")).withColumn("core", F.explode(F.sequence(F.lit(1), F.col("cores") - F.col("used"))))
    fullest = [F.desc("used"), F.col("container"), F.col("core")]
    own = free.where("node is not null").withColumn("instance", F.row_number().over(Window.partitionBy(key, "node").orderBy(*fullest))).select(key, "node", "instance", F.col("container").alias("own"))
    empty = free.where("node is null").withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*fullest))).select(key, "turn", F.col("container").alias("empty"))
    asked = requests.select(key, "node", F.explode(F.sequence(F.lit(1), F.col("instances"))).alias("instance")).join(own, [key, "node", "instance"], "left")
    over = F.when(F.col("own").isNull(), 1).otherwise(0)
    turn = F.when(over == 1, F.sum(over).over(Window.partitionBy(key).orderBy("node", "instance").rowsBetween(Window.unboundedPreceding, 0)))
    placed = asked.withColumn("turn", turn.cast("int")).join(empty, [key, "turn"], "left")
    return placed.select(key, "node", F.col("instance").cast("int").alias("instance"), F.coalesce("own", "empty").alias("container"))


def free_cores(c: str = "cores", u: str = "used") -> Column:
    return F.greatest(F.col(c) - F.col(u), F.lit(0))
