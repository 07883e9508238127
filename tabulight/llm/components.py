"""Connected components of links between ids, as joins on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label of that
    label, so paths halve; a hub with very many neighbours meets one label row in the
    join and is pre-aggregated in the grouping. Rounds are staged, so lineage stays short.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.filter("a is not null and b is not null and a <> b").distinct())
    labels = stage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (
            edges.join(labels, edges.b == labels.id)
            .groupBy("a").agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, labels.id == near.a).select(
            "id", F.least("component", "near").alias("mid"), F.col("component").alias("old")
        )
        of_label = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        fresh = stage(
            lower.join(of_label, "mid", "left")
            .select("id", F.least("mid", F.coalesce("far", "mid")).alias("component"), "old")
        )
        moved = fresh.filter("component < old").limit(1).count()
        labels = fresh.select("id", "component")
        if not moved:
            return labels
