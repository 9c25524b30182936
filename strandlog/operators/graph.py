"""Graph kernels on frames: nodes ``node`` and edges ``src, dst``.

Traversals work level by level: each level joins the frontier with the edges and leaves out
what was reached before, so a step costs as much as its frontier.  Levels are written to
the shared folder; nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.runtime import Scratch


def build_edges(links: DataFrame, id_col: str = "id", cause_col: str = "cause") -> DataFrame:
    """``src, dst`` for every row whose cause is set and is itself an id; repeated rows stay."""
    known = links.select(F.col(id_col).alias("__known")).where("__known is not null").distinct()
    rows = links.where(F.col(cause_col).isNotNull()).select(F.col(cause_col).alias("src"), F.col(id_col).alias("dst"))
    return rows.join(known, F.col("src") == F.col("__known"), "left_semi")


def find_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's target."""
    return nodes.join(edges.select(F.col("dst").alias("__x")).distinct(), F.col("node") == F.col("__x"), "left_anti")


def find_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's source."""
    return nodes.join(edges.select(F.col("src").alias("__x")).distinct(), F.col("node") == F.col("__x"), "left_anti")


def topo_levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """``node, level`` of a topological order, and whether every node could be placed.

    Level 0 has no sources, level n + 1 only sources up to level n.  Nodes on or behind a circle, or
    behind an unknown node, are left out; then the second value is False.  Order by
    (level, node) is a topological order.
    """
    scratch = Scratch(nodes.sparkSession, "topo")
    nodes = scratch.write(nodes.select("node").distinct(), "nodes", "rebalance")
    edges = scratch.write(edges.select("src", "dst").distinct(), "edges", "rebalance")
    total = nodes.count()
    rest, level, placed, out = nodes, 0, 0, None
    while True:
        ready = scratch.write(find_roots(rest, edges).withColumn("level", F.lit(level)), f"level{level}", "rebalance")
        n = ready.count()
        if not n:
            break
        placed += n
        out = ready if out is None else out.union(ready)
        if placed == total:
            break
        done = ready.select(F.col("node").alias("__done"))
        # Both tables shrink with every level; the old ones are dropped once the new are written.
        rest = scratch.write(rest.join(done, F.col("node") == F.col("__done"), "left_anti"), f"rest{level}", "rebalance")
        edges = scratch.write(edges.join(done, F.col("src") == F.col("__done"), "left_anti"), f"edges{level}", "rebalance")
        if level:
            scratch.drop(f"rest{level - 1}")
            scratch.drop(f"edges{level - 1}")
        level += 1
    if out is None:
        out = nodes.withColumn("level", F.lit(0)).limit(0)
    return out, placed == total


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    return not topo_levels(nodes, edges)[1]


def reach(edges: DataFrame, start: DataFrame, backward: bool = False, max_steps: int | None = None) -> DataFrame:
    """``start, node, distance``: everything reachable from each start (column ``start``) in the fewest steps.

    The starts themselves are included with distance 0.  Circles end where they meet what was
    reached.  The result has a row per start and reachable node; give few starts, or use
    ``hierarchy`` for whole forests.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = scratch.write(edges.select(F.col(a).alias("at"), F.col(b).alias("to")).where("at is not null and to is not null").distinct(), "edges", "rebalance")
    front = scratch.write(start.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).where("start is not null").distinct(), "front0", "rebalance")
    seen, k = front, 0
    while max_steps is None or k < max_steps:
        k += 1
        moved = front.join(steps, F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).distinct()
        old = seen.select(F.col("start").alias("o_start"), F.col("node").alias("o_node"))
        moved = moved.join(old, (F.col("start") == F.col("o_start")) & (F.col("node") == F.col("o_node")), "left_anti")
        front = scratch.write(moved.withColumn("distance", F.lit(k)), f"front{k}", "rebalance")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def has_path(edges: DataFrame, source: str, target: str) -> bool:
    """Can ``target`` be reached from ``source``?  A node reaches itself even if it is unknown."""
    if source == target:
        return True
    start = edges.sparkSession.createDataFrame([(source,)], "start string")
    return not reach(edges, start).where(F.col("node") == target).isEmpty()


def ancestors(edges: DataFrame, target: str) -> DataFrame:
    """``node, distance`` of all nodes that lead to the target, nearest first, without it."""
    start = edges.sparkSession.createDataFrame([(target,)], "start string")
    return reach(edges, start, backward=True).where(F.col("node") != target).select("node", "distance").orderBy("distance", "node")


def descendants(edges: DataFrame, source: str) -> DataFrame:
    """``node, distance`` of all nodes the source leads to, nearest first, without it."""
    start = edges.sparkSession.createDataFrame([(source,)], "start string")
    return reach(edges, start).where(F.col("node") != source).select("node", "distance").orderBy("distance", "node")


def root_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, distance``: fewest steps from any root; nodes no root leads to are left out."""
    scratch = Scratch(nodes.sparkSession, "depths")
    steps = scratch.write(edges.select("src", "dst").distinct(), "edges", "rebalance")
    front = scratch.write(find_roots(nodes.select("node").distinct(), steps).withColumn("distance", F.lit(0)), "front0", "rebalance")
    seen, k = front, 0
    while True:
        k += 1
        moved = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        moved = moved.join(seen.select(F.col("node").alias("o")), F.col("node") == F.col("o"), "left_anti")
        front = scratch.write(moved.withColumn("distance", F.lit(k)), f"front{k}", "rebalance")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``nodes, edges, roots, leaves, max_depth`` (fewest steps from a root, 0 without roots)."""
    distinct = nodes.select("node").distinct()
    parts = [
        distinct.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("k"), "n"),
        edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("k"), "n"),
        find_roots(distinct, edges).agg(F.count(F.lit(1)).alias("n")).select(F.lit("roots").alias("k"), "n"),
        find_leaves(distinct, edges).agg(F.count(F.lit(1)).alias("n")).select(F.lit("leaves").alias("k"), "n"),
        root_depths(nodes, edges).agg(F.coalesce(F.max("distance"), F.lit(0)).cast("long").alias("n")).select(F.lit("max_depth").alias("k"), "n"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    names = ["nodes", "edges", "roots", "leaves", "max_depth"]
    return whole.groupBy().agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in names])


def escape_dot(text):
    """Backslashes and double quotes escaped for a quoted DOT string; a column or a str."""
    if isinstance(text, str):
        return text.replace("\\", "\\\\").replace('"', '\\"')
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, line``: the lines of a DOT graph in any number of tasks; sort by (part, line) to write a file.

    ``nodes`` has ``node, type`` and optionally ``label``; the label line is left out without it.
    """
    label = F.concat(escape_dot(F.col("label")), F.lit("\\n"), escape_dot(F.col("type"))) if "label" in nodes.columns else escape_dot(F.col("type"))
    quoted = lambda c: F.concat(F.lit('"'), escape_dot(F.col(c)), F.lit('"'))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted("node"), F.lit(' [label="'), label, F.lit('"];')).alias("line"))
    e = edges.select(F.lit(2), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")))
    return n.union(e)


def to_dot(nodes: DataFrame, edges: DataFrame, name: str = "causation") -> str:
    """A DOT text for a graph small enough to be looked at: top to bottom, rounded boxes, quoted ids."""
    lines = [r.line for r in dot_lines(nodes, edges).orderBy("part", "line").toLocalIterator()]
    return "\n".join([f"digraph {name} {{", "  rankdir=TB;", "  node [shape=box, style=rounded];", *lines, "}"]) + "\n"
