"""Connected components of a graph given by its links, as rounds of contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.common import stage


def _mapped(links: DataFrame, label: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        renamed = label.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        links = links.join(renamed, side).drop(side).withColumnRenamed(f"{side}_label", side)
    return links.select("a", "b").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round points every node at its smallest neighbour, follows two such
    pointers more, and contracts the graph by them. The number of nodes falls
    by a factor with every round, and each round is written to a stage table.
    Links to itself are no links; nulls must be gone.
    """
    spark = links.sparkSession
    links = stage(links.select("a", "b").filter("a <> b").distinct())
    rounds = []
    while links.limit(1).count():
        ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        label = stage(least.select("node", F.least("node", "b").alias("label")))
        for _ in range(2):
            onward = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
            label = label.join(onward, "label").select("node", F.col("next").alias("label"))
        label = stage(label)
        rounds.append(label)
        links = stage(_mapped(links, label))
    if not rounds:
        return spark.createDataFrame([], "node bigint, component bigint")

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        target = later.select(F.col("node").alias("label"), "component")
        joined = earlier.join(target, "label", "left")
        return joined.select("node", F.coalesce("component", "label").alias("component"))

    last = rounds[-1].select("node", F.col("label").alias("component"))
    return stage(reduce(compose, reversed(rounds[:-1]), last))
