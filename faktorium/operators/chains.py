"""Chains of references: every row points to another one, which may point on.

The chains are followed by pointer jumping: a row that points to a row points,
after a round, to where that one points.  A chain of n steps takes log2(n)
rounds, each one join; rows that have arrived leave the rounds.  As long as some
chain ends, every round lets a row arrive: when none does, what is left goes in
circles.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.session import work_path


def _stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def find_roots(spark: SparkSession, links: DataFrame, node: str, target: str) -> DataFrame:
    """``node, root, steps, is_cycle``: where the chain of every row ends, and after how many steps.

    ``links`` has one row per node with its target; targets without a row of
    their own are roots.  Chains that lead into a circle have no root.  Rows
    without a node or a target are left out.
    """
    start = links.select(F.col(node).alias("node"), F.col(target).alias("to")).where("node IS NOT NULL AND to IS NOT NULL")
    nodes = start.select(F.col("node").alias("to"), F.lit(True).alias("_goes_on"))
    table = _stored(
        spark,
        start.join(nodes, "to", "left").select("node", "to", F.lit(1).cast("long").alias("steps"), F.col("_goes_on").isNull().alias("done")),
        "chains",
    )
    waiting, before = table.where("NOT done").count(), None
    while waiting and waiting != before:
        there = table.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = table.where("NOT done").join(there, "to").select(
            "node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done")
        )
        table = _stored(spark, table.where("done").unionByName(moved), "chains")
        waiting, before = table.where("NOT done").count(), waiting
    return table.select(
        F.col("node").alias(node), F.when(F.col("done"), F.col("to")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("steps"),
        (~F.col("done")).alias("is_cycle"),
    )


def ancestors(spark: SparkSession, links: DataFrame, node: str, target: str, most: int = 64) -> DataFrame:
    """``node, ancestor, steps``: everything that a row leads to, for short chains such as those of types.

    Pairs are joined with themselves, so the steps that are known double in each
    round; chains of more than ``most`` steps, and circles, are an error.
    """
    first = links.select(F.col(node).alias("node"), F.col(target).alias("ancestor"), F.lit(1).cast("long").alias("steps"))
    pairs = _stored(spark, first.where("node IS NOT NULL AND ancestor IS NOT NULL").distinct(), "ancestors")
    known, reach = pairs.count(), 1
    while True:
        on = pairs.where(F.col("steps") <= reach).select(
            F.col("node").alias("ancestor"), F.col("ancestor").alias("_ancestor"), F.col("steps").alias("_steps")
        )
        longer = pairs.where(F.col("steps") == reach).join(on, "ancestor").select(
            "node", F.col("_ancestor").alias("ancestor"), (F.col("steps") + F.col("_steps")).alias("steps")
        )
        pairs = _stored(spark, pairs.unionByName(longer), "ancestors")
        reach *= 2
        now = pairs.count()
        if now == known:
            return pairs.select(F.col("node").alias(node), "ancestor", "steps")
        if reach > most:
            raise ValueError(f"chains of more than {most} steps, or a circle")
        known = now
