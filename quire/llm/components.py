"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    Each round a node takes the smallest label among itself and its neighbours,
    then the label of that label, so labels travel twice as far every round.
    Every round is written to the shared folder, so a lost executor costs no
    more than a round; rounds end when no label changes. Links of a hub, and the
    nodes of one label, meet that hub's or label's single row in a plain join of
    two stored tables, whose large partitions Spark splits between tasks; minima
    are made in each task first. Links with a null end or of a node with itself
    are ignored, repeated ones count once, and a table without links has no rows.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter(F.col("x") != F.col("y")).distinct(), "links")
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("m"))
        step = labels.join(near.select(F.col("x").alias("node"), "m"), "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        step = cut(step, "steps")
        of = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        step = cut(step.join(of, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component"), "old"), "labels")
        changed = step.filter(F.col("component") != F.col("old")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
