"""Connected components by randomised contraction (Boegeholz, Brand, Todor 2020), as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) to (node, root): all nodes of a component get the same root, one of them.

    Each round maps every node to the neighbour (or itself) of least random priority and
    relabels the edges, so the graph shrinks by a constant factor; no component is gathered in
    a task. Self-links and repeated edges are harmless; no edges give no rows.
    """
    e = edges.where("a <> b").select("a", "b")
    e = written(e.union(e.select("b", "a")).distinct(), "edges")
    out = None
    for turn in range(200):
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("p"), c.alias("v"))
        least = e.groupBy("a").agg(F.least(F.min(rank(F.col("b"))), rank(F.col("a"))).getField("v").alias("r"))
        least = written(least, "least")
        out = least.select(F.col("a").alias("node"), F.col("r").alias("root")) if out is None else (
            out.join(least, F.col("root") == F.col("a"), "left").select("node", F.coalesce("r", "root").alias("root")))
        a, b = least.toDF("a", "ra"), least.toDF("b", "rb")
        e = written(e.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if e.isEmpty():
            return out
    raise RuntimeError("components did not settle")
