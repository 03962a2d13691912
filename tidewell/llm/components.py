"""Connected components of a link table, by hooking to the smallest neighbour and pointer jumping.

Every table stays distributed and every round ends in a reliable checkpoint. A round hooks each node to its
smallest neighbour, jumps pointers until each node knows its root, and contracts the links to roots; the
number of roots with links at least halves. Once at most ``LOCAL_LINKS`` links are left, one task finishes them, for rounds of a cluster
over so few rows cost only jobs. Joins run against a table with one row for each node, so a node with very
many links only makes one side of a join uneven, which AQE splits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import durable, sized_broadcast


LOCAL_LINKS = 200_000  # of 16 bytes


def _finish(batches):
    """(node, root) of at most LOCAL_LINKS links, by the same hooking and jumping on arrays."""
    frames = list(batches)
    if not frames or not sum(map(len, frames)):
        return
    links = pd.concat(frames)[["a", "b"]].to_numpy(np.int64)
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(links.shape).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], low)
        np.minimum.at(hooked, root[b], low)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        hooked = hooked[root]
        if (hooked == root).all():
            break
        root = hooked
    own = root != np.arange(len(nodes))
    yield pd.DataFrame({"node": nodes[own], "root": nodes[root[own]]})


def _roots(parent: DataFrame) -> DataFrame:
    """Each node's root from (node, root), where roots have no row of their own."""
    while True:
        up = parent.select(F.col("node").alias("_up"), F.col("root").alias("_next"))
        jumped = durable(parent.join(sized_broadcast(up, parent.count()), F.col("root") == F.col("_up"), "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        parent = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """(node, root) for nodes that are not the smallest of their component; links are (a, b)."""
    links = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    found: DataFrame | None = None

    def settle(roots: DataFrame) -> DataFrame:
        if found is None:
            return roots
        new = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        known = found.join(sized_broadcast(new, roots.count()), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
        return durable(known.unionByName(roots))

    while links.count() > LOCAL_LINKS:
        roots = _roots(durable(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))))
        n = roots.count()
        found = settle(roots)
        for side in ("a", "b"):
            own = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            links = links.join(sized_broadcast(own, n), F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_r", side)).drop("_n", "_r")
        links = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    return settle(durable(links.repartition(1).mapInPandas(_finish, "node long, root long")))
