"""Connected components of a link table, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: So many links (16 bytes each) are joined in one task; more by rounds of shuffles.
FEW_LINKS = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of a table of links (u > v) that is known to be small."""
    held = list(batches)
    u, v = (np.concatenate([np.zeros(0, np.int64), *(b.column(i).to_numpy(zero_copy_only=False) for b in held)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # Each root takes the smallest root that a link of its tree reaches; then trees are made flat.
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while not np.array_equal(low, low[low]):
            low = low[low]
        now = low[root]
        if np.array_equal(now, root):
            break
        root = now
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself: then that is its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links reach, for every node of a link.

    A table of at most FEW_LINKS is worked on in one task. A larger one goes through alternating large and small stars:
    the links of each node are rehung to the smallest node it knows, until they are stars. A round costs two
    aggregations; a node's neighbours are never gathered, only their minimum is.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    edges = cut(edges)
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    while not _stars(edges):
        # Large star: of every node, its larger neighbours go to the smallest node among it and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: of every node, it and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
