"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerleaf.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node of each linked node's component.

    Parents are hooked to smaller grandparents and shortened at once, so the
    number of rounds grows with the logarithm of the longest path. Each round is
    written to the shared folder.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges").toDF("u", "v")
    parents = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("parent")), "parents")
    while True:
        up = parents.toDF("parent", "grand")
        known = parents.join(up, "parent").select("node", "parent", "grand")
        seen = edges.join(known.select(F.col("node").alias("v"), F.col("grand").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        offered = known.join(seen.withColumnRenamed("u", "node"), "node")
        merged = (
            offered.select("node", F.least("grand", "near").alias("parent"))
            .union(offered.select("parent", "near"))
            .groupBy("node").agg(F.min("parent").alias("parent"))
        )
        following = stored(merged, "parents")
        if following.join(parents.withColumnRenamed("parent", "was"), "node").where("parent <> was").isEmpty():
            return following.withColumnRenamed("parent", "label")
        parents = following
