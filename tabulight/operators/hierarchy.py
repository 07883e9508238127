"""Levels and paths of parent/child tables of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def tree_paths(nodes: DataFrame, node: str, parent: str, label: str, separator: str = " > ") -> DataFrame:
    """Root, level (roots are 1) and path of each node.

    Each round joins every open node to the node it points at and takes over that
    node's own pointer, so the reach doubles and a tree of depth d needs log2(d)
    rounds. As long as an open node can still be closed, a round closes one; rounds
    end when none did, and the nodes left lie on a cycle, or below one, and get a null
    level. Only open nodes are joined. Rounds are written to the checkpoint folder so the
    plan stays flat. A parent with very many children is a hot key on the left side only, where adaptive
    execution splits it.
    """
    state = stage(
        nodes.select(
            F.col(node).alias("node"),
            F.col(parent).alias("up"),
            F.col(node).alias("root"),
            F.lit(1).alias("level"),
            F.col(label).cast("string").alias("path"),
        )
    )
    open_nodes = state.filter("up IS NOT NULL").count()
    while open_nodes:
        above = state.select(
            F.col("node").alias("up"),
            F.col("up").alias("next_up"),
            F.col("root").alias("next_root"),
            F.col("level").alias("add_level"),
            F.col("path").alias("lead"),
        )
        found = F.col("add_level").isNotNull()
        closed_rows = state.filter("up IS NULL")
        moved = (
            state.filter("up IS NOT NULL").join(above, "up", "left").select(
                "node",
                F.col("next_up").alias("up"),
                F.when(found, F.col("next_root")).otherwise(F.col("root")).alias("root"),
                (F.col("level") + F.coalesce("add_level", F.lit(0))).alias("level"),
                F.when(found, F.concat("lead", F.lit(separator), "path"))
                .otherwise(F.col("path"))
                .alias("path"),
            )
        )
        state = stage(moved.unionByName(closed_rows))
        left = state.filter("up IS NOT NULL").count()
        if left == open_nodes:
            break
        open_nodes = left
    closed = F.col("up").isNull()
    return state.select(
        F.col("node").alias(node),
        F.when(closed, F.col("root")).alias("root"),
        F.when(closed, F.col("level")).alias("level"),
        F.when(closed, F.col("path")).alias("path"),
    )
