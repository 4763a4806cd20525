"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.frames import small_side
from vicinal.plans.sizing import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for both ends of ``edges`` (``u, v``): the lowest node of its component.

    Each round every node takes the lowest label of its neighbours and then the label of that
    label, so that the rounds grow with the logarithm of a chain's length.  A round is written to
    the shared folder.  Minima are aggregated ahead of the shuffle: a node with any number of
    links is no burden.
    """
    edges = cut_lineage(edges)
    both = cut_lineage(edges.union(edges.select("v", "u")).distinct())
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")))
    while True:
        seen = both.join(small_side(labels.select(F.col("node").alias("v"), "label")), "v")
        lower = seen.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = cut_lineage(
            labels.join(lower, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        )
        jump = small_side(hooked.select(F.col("node").alias("label"), F.col("label").alias("root")))
        nearer = cut_lineage(hooked.join(jump, "label", "left").select("node", F.least("label", "root").alias("label"), "old"))
        moved = not nearer.filter("label != old").isEmpty()
        labels = nearer.select("node", "label")
        if not moved:
            return labels
