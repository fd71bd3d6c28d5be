"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.

    Every round maps a node to the one of least hash among itself and its neighbours, and on to what
    that is mapped to; edges become edges between the mapped nodes, and those within one go, so each
    round has a share of the last's. Hashes keep long paths from shrinking by their ends alone. Only
    whether edges are left reaches the driver. A node of many edges is pre-aggregated before
    each shuffle. Tables of earlier rounds are removed.
    """
    cuts = Cuts(edges.sparkSession)
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where(F.col("node") != F.col("other"))
    both = cuts.cut("edges", both.union(both.select("other", "node")).distinct())
    placed = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id"))
    found = None
    while True:
        least = cuts.cut("least", both.groupBy("node").agg(F.least(placed("node"), F.min(placed("other")))["id"].alias("low")))
        onward = least.select(F.col("node").alias("low"), F.col("low").alias("to"))
        moved = cuts.cut("moved", least.join(onward, "low").select("node", "to"))
        if found is None:
            found = cuts.cut("found", moved.select("node", F.col("to").alias("component")))
        else:
            next_ = moved.select(F.col("node").alias("component"), "to")
            found = cuts.cut("found", found.join(next_, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        ends = both.join(moved, "node").select("other", F.col("to").alias("a"))
        ends = ends.join(moved.select(F.col("node").alias("other"), F.col("to").alias("b")), "other")
        both = cuts.cut("edges", ends.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct())
        if both.isEmpty():
            for table in ("edges", "least", "moved"):
                cuts.drop(table)
            smallest = found.groupBy("component").agg(F.min("node").alias("least"))
            return cuts.cut("found", found.join(smallest, "component").select("node", F.col("least").alias("component")))
