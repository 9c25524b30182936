"""Parent links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.runtime import Scratch, heavy_keys, join_to_unique

HEAVY_SHARE = 0.005
SALTS = 32


def _hot(df: DataFrame, key: str) -> tuple[int, list[int]]:
    """Number of pointers, and hashes of the values of ``key`` that hold a large share of them, in one pass."""
    return heavy_keys(df, [key], HEAVY_SHARE)


def hierarchy(df: DataFrame, id_col: str, parent_col: str, with_paths: bool = False, only_children: bool = False, with_walks: bool = False) -> DataFrame:
    """Root, depth and optionally the path of every node of a forest given by parent links.

    Returns ``node, parent, root, depth`` and with ``with_paths`` also ``path``, the ids
    from the root to the node.  A node whose parent is null, empty or not a node is a root
    (depth 0, root itself).  A node that runs into a circle has depth -1, a null path and as
    root the smallest id of that circle.  ``with_walks`` (which needs the paths) adds ``walk``:
    for a node in or below a circle the ids met going up from it, itself first, each once; null
    for all others.  ``only_children`` leaves out nodes without a parent value.  Repeated rows of a node count once; of contradicting parents the
    smallest counts; rows with a null id are no nodes.  An empty table gives no rows.

    Only nodes with children can be pointed at, so only those take part in the doubling:
    in round k each open pointer jumps from distance 2^k to 2^(k+1) by one join with the
    table of pointers, and pointers that reached a root are closed.  The open set shrinks
    with the depth that is left.  When a round closes nothing, every open node leads
    into a circle, because the ancestors of a node at depth d cover all smaller depths.
    Rounds are written to the shared folder.  They move numbers only; what the numbers of a
    path stand for is looked up once, when all paths are whole.
    """
    if with_walks and not with_paths:
        raise ValueError("walks need with_paths")
    spark = df.sparkSession
    scratch = Scratch(spark, "hierarchy")
    merge = "coalesce" if with_paths else "rebalance"
    has_parent = F.col("parent").isNotNull() & (F.col("parent") != "")
    links = df.select(F.col(id_col).cast("string").alias("node"), F.col(parent_col).cast("string").alias("parent")).where(F.col("node").isNotNull())
    links = links.withColumn("parent", F.when(has_parent, F.col("parent")))
    as_node = F.struct(F.col("node").alias("key"), F.col("parent").alias("parent"), F.lit(True).alias("is_node"), F.lit(False).alias("is_ref"))
    as_parent = F.struct(F.col("parent").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("is_node"), F.lit(True).alias("is_ref"))
    marks = links.select(F.explode(F.when(F.col("parent").isNull(), F.array(as_node)).otherwise(F.array(as_node, as_parent))).alias("m")).select("m.*")
    # One pass tells of each id whether it is a node, what its parent is and whether anything points at it.
    nodes = marks.groupBy("key").agg(F.min("parent").alias("parent"), F.max("is_node").alias("is_node"), F.max("is_ref").alias("is_ref"))
    nodes = nodes.where(F.col("is_node"))
    if only_children:
        nodes = nodes.where(F.col("parent").isNotNull() | F.col("is_ref"))
    nodes = scratch.write(nodes.select("key", "parent", "is_ref", F.monotonically_increasing_id().alias("num")), "nodes")

    inner = nodes.where(F.col("is_ref"))
    _, hot = _hot(inner, "parent")
    ids = inner.select(F.col("key").alias("p_key"), F.col("num").alias("p_num"))
    base = join_to_unique(inner, ids, "parent", "p_key", "left", hot, SALTS, ["num"])
    closed = F.col("p_num").isNull()
    cols = [F.col("num"), F.coalesce("p_num", "num").alias("ptr"), F.when(closed, 0).otherwise(1).cast("long").alias("dist"), closed.alias("closed")]
    if with_paths:
        cols.append(F.when(closed, F.array().cast("array<bigint>")).otherwise(F.array("num")).alias("seg"))  # numbers from the node up to, without, ptr
    rounds = [scratch.write(base.select(*cols), "round0", merge)]
    open_rows, hot = _hot(rounds[0].where(~F.col("closed")), "ptr")
    names = rounds[0].columns
    first_open = None
    while open_rows:
        last = rounds[-1]
        table = last.where(~F.col("closed"))
        for r in rounds:
            table = table.union(r.where(F.col("closed")))
        target = table.select(*[F.col(c).alias(f"t_{c}") for c in names])
        active = last.where(~F.col("closed"))
        step = join_to_unique(active, target, "ptr", "t_num", "inner", hot, SALTS, ["num"])
        out = [F.col("num"), F.col("t_ptr").alias("ptr"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.col("t_closed").alias("closed")]
        if with_paths:
            out.append(F.concat("seg", "t_seg").alias("seg"))
        rounds.append(scratch.write(step.select(*out), f"round{len(rounds)}", merge))
        left, hot = _hot(rounds[-1].where(~F.col("closed")), "ptr")
        if left == open_rows:
            first_open = rounds[-1].where(~F.col("closed")).select("num")
            rounds.pop()
            break
        open_rows = left

    found = None
    for r in rounds:
        part = r.where(F.col("closed"))
        found = part if found is None else found.union(part)
    names_of = inner.select(F.col("num").alias("k_num"), F.col("key").alias("k_key"))
    # Heavy roots: a tree may hold a third of all nodes.
    found = join_to_unique(found, names_of, "ptr", "k_num", "inner", _hot(found, "ptr")[1], SALTS, ["num"])
    solved = found.select("num", F.col("k_key").alias("root"), "dist", *(["seg"] if with_paths else []))
    if first_open is not None:
        circular = _circles(scratch, first_open, rounds[0].select("num", "ptr"), inner, open_rows)
        seg = F.lit(None).cast("array<bigint>")
        if with_walks:
            circular, seg = circular.join(_walks(scratch, rounds[-1].where(~F.col("closed")), merge), "num"), F.col("walk")
        solved = solved.union(circular.select("num", "root", F.lit(-1).cast("long"), *([seg] if with_paths else [])))
    if with_paths:
        solved = _named(scratch, solved, names_of, merge)
    solved = solved.join(inner.select(F.col("num").alias("i_num"), F.col("key").alias("up")), F.col("num") == F.col("i_num"))
    solved = scratch.write(solved.select("up", F.col("root").alias("up_root"), F.col("dist").alias("up_dist"), *([F.col("seg").alias("up_seg")] if with_paths else [])), "solved", merge)

    with_parent = nodes.where(F.col("parent").isNotNull())
    rows = join_to_unique(with_parent, solved, "parent", "up", "left", _hot(with_parent, "parent")[1], SALTS, ["num"])
    top = F.col("up").isNull()
    circle = F.col("up_dist") < 0
    out = [
        F.col("key").alias("node"),
        "parent",
        F.when(top, F.col("key")).otherwise(F.col("up_root")).alias("root"),
        F.when(top, F.lit(0)).when(circle, F.lit(-1)).otherwise(F.col("up_dist") + 1).cast("long").alias("depth"),
    ]
    if with_paths:
        up_path = F.concat(F.array("up_root"), F.reverse("up_seg"))
        # seg holds the ids from the parent up to the child of the root; reversed it runs downwards.
        out.append(F.when(top, F.array("key")).when(circle, F.lit(None)).otherwise(F.concat(up_path, F.array("key"))).alias("path"))
    if with_walks:
        out.append(F.when(circle, F.array_distinct(F.concat(F.array("key"), "up_seg"))).alias("walk"))
    result = rows.select(*out)
    if not only_children:
        alone = nodes.where(F.col("parent").isNull())
        lone = [F.col("key"), "parent", F.col("key"), F.lit(0).cast("long")] + ([F.array("key")] if with_paths else []) + ([F.lit(None).cast("array<string>")] if with_walks else [])
        result = result.union(alone.select(*lone))
    return result


def _named(scratch: Scratch, solved: DataFrame, names: DataFrame, merge: str) -> DataFrame:
    """``solved`` with the numbers of ``seg`` replaced by ids, each number joined with its id once per path.

    An ancestor near a root may lie in a third of all paths; its rows are spread.
    """
    solved = scratch.write(solved, "numbered", merge)
    parts = solved.select("num", F.posexplode("seg").alias("at", "of"))
    ids = names.select(F.col("k_num").alias("n_num"), F.col("k_key").alias("n_key"))
    parts = join_to_unique(parts, ids, "of", "n_num", "inner", _hot(parts, "of")[1], SALTS, ["num"])
    paths = parts.groupBy(F.col("num").alias("p_num")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n_key"))), lambda x: x["n_key"]).alias("ids"))
    empty = F.when(F.col("seg").isNotNull(), F.array().cast("array<string>"))
    return solved.join(paths, F.col("num") == F.col("p_num"), "left").select("num", "root", "dist", F.coalesce("ids", empty).alias("seg"))


def _circles(scratch: Scratch, open_nodes: DataFrame, first: DataFrame, inner: DataFrame, n: int) -> DataFrame:
    """``num, root`` of the nodes that lead into circles; root is the circle's smallest id.

    All ancestors of such a node are such nodes, so a walk of ``n`` steps from any of them
    ends on its circle, and a walk of ``n`` steps from there sees the whole circle.  Both
    are found by doubling the step, carrying the smallest id seen on the way.
    """
    walk = open_nodes.join(first, "num").join(inner.select("num", F.col("key").alias("low")), "num").select("num", "ptr", "low")
    walk = scratch.write(walk, "walk0", "rebalance")
    steps, k = 1, 0
    while steps < n:
        far = walk.select(F.col("num").alias("f_num"), F.col("ptr").alias("f_ptr"), F.col("low").alias("f_low"))
        _, hot = _hot(walk, "ptr")
        walk2 = join_to_unique(walk, far, "ptr", "f_num", "inner", hot, SALTS, ["num"]).select("num", F.col("f_ptr").alias("ptr"), F.least("low", "f_low").alias("low"))
        k += 1
        walk = scratch.write(walk2, f"walk{k}", "rebalance")
        if k > 1:
            scratch.drop(f"walk{k - 1}")
        steps *= 2
    end = walk.select(F.col("num").alias("f_num"), F.col("low").alias("root"))
    return join_to_unique(walk.select("num", "ptr"), end, "ptr", "f_num", "inner", _hot(walk, "ptr")[1], SALTS, ["num"]).select("num", "root")


def _walks(scratch: Scratch, open_nodes: DataFrame, merge: str) -> DataFrame:
    """``num, walk`` of the nodes that lead into circles: the numbers from the node up to the end of the circle, each once.

    ``open_nodes`` are the last pointers with their segments.  A walk that met an id again has
    seen its whole circle and is closed; open ones are doubled further, so the rounds go with
    the logarithm of tail and circle.
    """
    once = F.array_distinct("seg")
    rounds = [scratch.write(open_nodes.select("num", "ptr", once.alias("walk"), (F.size(once) < F.size("seg")).alias("closed")), "ring0", merge)]
    while rounds[-1].where(~F.col("closed")).limit(1).count():
        active = rounds[-1].where(~F.col("closed"))
        table = active
        for r in rounds:
            table = table.union(r.where(F.col("closed")))
        target = table.select(*[F.col(c).alias(f"t_{c}") for c in table.columns])
        step = join_to_unique(active, target, "ptr", "t_num", "inner", _hot(active, "ptr")[1], SALTS, ["num"])
        walk = F.array_distinct(F.concat("walk", "t_walk"))
        met = F.col("t_closed") | (F.size(walk) < F.size("walk") + F.size("t_walk"))
        rounds.append(scratch.write(step.select("num", F.col("t_ptr").alias("ptr"), walk.alias("walk"), met.alias("closed")), f"ring{len(rounds)}", merge))
    found = rounds[0].where(F.col("closed"))
    for r in rounds[1:]:
        found = found.union(r.where(F.col("closed")))
    return found.select("num", "walk")


def effects(paths: DataFrame) -> DataFrame:
    """All descendants of every node: ``ancestor, node, distance`` from ``hierarchy(..., with_paths=True)``.

    One row per pair of a node and one of its proper ancestors, made from the paths without
    another join.  Nodes in or below circles have no path; they give their pairs, with the
    fewest steps as distance and never themselves, if the table has the column ``walk``
    (``with_walks=True``), and none without it.
    """
    if "walk" in paths.columns:
        up = paths.where(F.col("depth") != 0).select("node", F.posexplode(F.coalesce(F.reverse("path"), "walk")).alias("at", "ancestor"))
        return up.where(F.col("at") > 0).select("ancestor", "node", F.col("at").cast("long").alias("distance"))
    up = paths.where(F.col("depth") > 0).select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where(F.col("at") < F.col("depth")).select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
