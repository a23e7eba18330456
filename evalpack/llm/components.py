"""Connected components of a link table, by label passing with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable. Only nodes with a link appear.

    Every round takes the smallest label among the neighbours and then jumps to
    the label's own label, so the rounds grow with the logarithm of a chain.
    Each round is written to the shared folder. Minima combine before the
    shuffle, so a node with very many links costs one row a task.
    """
    one = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(one.union(one.select("other", "node")).where("node <> other").distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("label").alias("m")))
        lower = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(lower.join(jump, "label").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if not new.where("label < was").limit(1).count():
            return labels
