"""Connected components of an edge table by repeated minimum labels and pointer jumps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b bigint, not null): the smallest node it reaches.

    A round gives each node the smallest label around it, then the label of its label. Minima are taken by partial aggregation, so a hub is not
    gathered in one task. Every round is written to the shared folder. Rounds go on until no label falls. No edges: no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.least("label", "near").alias("up"), F.col("label").alias("was"))
        met = cut_lineage(met)
        above = met.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = met.join(above, "up").select("node", F.least("up", "top").alias("label"), "was")
        new = cut_lineage(new)
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of links (a, b) into ``parent``, which points straight at the smallest member before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
