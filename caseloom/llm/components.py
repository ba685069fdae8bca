"""Connected components of a table of links, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``v, c`` for every end of the links (columns a, b): c is the smallest id reachable.

    Each round gives every vertex the smallest label among its neighbours, then the label of that label.
    Labels are written to the shared folder once a round; only a count of changes reaches the driver.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("v", "w").distinct()
    both = cut_lineage(both)
    labels = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("d")), "w")
        best = near.groupBy("v").agg(F.min("d").alias("d"))
        step = labels.join(best, "v").select("v", F.col("c").alias("old"), F.least("c", "d").alias("c"))
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("e"))
        step = step.join(up, "c").select("v", "old", F.least("c", "e").alias("c"))
        step = cut_lineage(step)
        changed = step.filter("c <> old").limit(1).count()
        labels = step.select("v", "c")
        if not changed:
            return labels
