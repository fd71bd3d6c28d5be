"""Mention graphs: edges, components by day, reachability in time."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mentions
from ..session import checkpointed


def registry(rows: DataFrame) -> DataFrame:
    """(name) of all who spoke, but for Unknown."""
    return rows.select(F.col("speaker").alias("name")).where("name <> '' and name <> 'Unknown'").distinct()


def names_of(registry: DataFrame, most: int = 10_000) -> list[str]:
    """The registered names for a name pattern; more than ``most`` make no pattern and are an error."""
    found = [r["name"] for r in registry.orderBy("name").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} names")
    return found


def mention_edges(rows: DataFrame, names: list[str]) -> DataFrame:
    """(day, src, dst, n): names that a day's messages mention, without the speaker's own."""
    found = rows.select("day", F.col("speaker").alias("src"), F.explode(mentions(F.col("text"), names)).alias("dst"))
    return found.where("src <> dst").groupBy("day", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def edge_examples(rows: DataFrame, names: list[str]) -> DataFrame:
    """(src, dst, n, day, event_index) of all days: how often, and where first."""
    found = rows.select("day", "event_index", F.col("speaker").alias("src"), F.explode(mentions(F.col("text"), names)).alias("dst"))
    sums = found.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "event_index")).alias("at"))
    return sums.select("src", "dst", "n", "at.day", "at.event_index")


def top_edges(edges: DataFrame, k: int = 100) -> DataFrame:
    """The heaviest edges (src, dst, n), by weight and names."""
    return edges.orderBy(F.desc("n"), "src", "dst").limit(k)


def active_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges to those who also spoke that day."""
    spoke = rows.select("day", F.col("speaker").alias("dst")).distinct()
    return edges.join(spoke, ["day", "dst"], "left_semi")


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(day, node, component) of undirected edges (day, src, dst) over nodes (day, node); the component is its least node.

    Each round every node takes the least label among its neighbours, then the label of that label;
    graphs of any size are joined, not held. Rounds end when no label changes.
    """
    ends = edges.select("day", F.col("src").alias("node"), F.col("dst").alias("other"))
    both = checkpointed(ends.union(ends.select("day", "other", "node")).where("node <> other").distinct())
    known = nodes.select("day", "node").union(both.select("day", "node")).distinct()
    labels = checkpointed(known.withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select("day", F.col("node").alias("other"), F.col("component").alias("near")), ["day", "other"])
        low = labels.join(near.groupBy("day", "node").agg(F.min("near").alias("near")), ["day", "node"], "left")
        low = low.select("day", "node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = labels.select("day", F.col("node").alias("low"), F.col("component").alias("jump"))
        grown = checkpointed(low.join(jump, ["day", "low"], "left").select("day", "node", "was", F.least("low", "jump").alias("component")))
        labels = grown.drop("was")
        if grown.where("component <> was").isEmpty():
            return labels


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(day, components, largest) of undirected edges (day, src, dst) over nodes (day, node), isolated ones included."""
    sizes = component_labels(nodes, edges).groupBy("day", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("day").agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))


def reachable(roots: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Nodes reached from roots (node, at) over edges (src, dst, at) that never go back in time.

    Each round joins the newly reached nodes alone, keeps the earliest arrival, and stops when
    none is new or earlier. A bound of rounds that is met before that is an error.
    """
    reached = roots.groupBy("node").agg(F.min("at").alias("at"))
    for _ in count() if most_rounds is None else range(most_rounds):
        steps = reached.alias("r").join(edges.alias("e"), (F.col("r.node") == F.col("e.src")) & (F.col("e.at") >= F.col("r.at")))
        found = steps.select(F.col("e.dst").alias("node"), F.col("e.at").alias("at"))
        grown = checkpointed(reached.unionByName(found).groupBy("node").agg(F.min("at").alias("at")))
        if grown.exceptAll(reached).isEmpty():
            return grown
        reached = grown
    raise RuntimeError(f"nodes are still newly reached after {most_rounds} rounds")


def renamed(ids: Column, aliases: dict[str, str]) -> Column:
    """An array of ids with aliases replaced; the alias table is an argument, so small."""
    if not aliases:
        return ids
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(ids, lambda i: F.coalesce(table[i], i))
