"""Connected components by hooking and shortcutting, all in DataFrames.

Each round gives every node the smallest label among its neighbours, flattens
the chains that arise by pointer doubling, and contracts the edges to the
labels that are left.  Minima are aggregated before they are shuffled, so the
centre of a large star is no hot spot; every round is a table, so lost
executors cost a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the smallest node it reaches.

    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    left = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            jumped = saved(jumped, "parents")
            parent = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:  # nodes keep the label of their label
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = saved(labels.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        name = lambda old, new: parent.select(F.col("node").alias(old), F.col("root").alias(new))
        left = saved(left.join(name("a", "x"), "a").join(name("b", "y"), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return labels
