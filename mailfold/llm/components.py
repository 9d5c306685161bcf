"""Connected components of a link table, as Spark joins with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def connected_components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest reachable node.

    Each round takes, for every node, the least label among its neighbours and
    then the label of that label, so labels travel twice as far each time.
    Rounds are written tables; one boolean per round reaches the driver.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.where("a <> b").select(F.explode(ways).alias("way")).select("way.a", "way.b")
    both = materialise(both.distinct(), f"{purpose}-links")
    labels = materialise(both.groupBy(F.col("a").alias("node"))
                             .agg(F.least("node", F.min("b")).alias("root")), f"{purpose}-0")
    turn = 0
    while True:
        turn += 1
        offers = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                      .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer")))
        nearer = labels.join(offers, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "offer").alias("near"))
        parents = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        step = nearer.join(parents, "near").select(
            "node", F.least("near", "far").alias("root"), (F.least("near", "far") < F.col("old")).alias("moved"))
        step = materialise(step, f"{purpose}-{turn}")
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels
