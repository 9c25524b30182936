"""Decisions on the state of a store's nodes, from tables of what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.runtime import block_of, running_by_slots

FAILED_AFTER = 3
LAG_OK = 100


def quorum(total: int, up: int) -> dict:
    need = total // 2 + 1
    return {"total": total, "available": up, "required": need, "has_quorum": up >= need, "margin": up - need}


def membership_views(views: DataFrame) -> DataFrame:
    """``check_id, nodes, views, status`` from ``check_id, node, member`` rows: what each node sees as members.

    More than one distinct view of a check is a split brain.
    """
    seen = views.groupBy("check_id", "node").agg(F.array_sort(F.collect_set("member")).alias("view"))
    out = seen.groupBy("check_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("view").alias("views"))
    return out.withColumn("status", F.when(F.col("views") > 1, "split_brain").otherwise("consensus"))


def leader_views(views: DataFrame) -> DataFrame:
    """``check_id, leaders, status`` from ``check_id, node, leader``: one, several, or nobody known as leader."""
    out = views.groupBy("check_id").agg(F.count_distinct("leader").alias("leaders"))
    return out.withColumn("status", F.when(F.col("leaders") == 1, "consensus").when(F.col("leaders") == 0, "no_leader").otherwise("disagreement"))


def replication_lag(state: DataFrame) -> DataFrame:
    """``check_id, terms, lag, status`` from ``check_id, node, term, commit_index``."""
    out = state.groupBy("check_id").agg(F.count_distinct("term").alias("terms"), (F.max("commit_index") - F.min("commit_index")).alias("lag"))
    return out.withColumn("status", F.when((F.col("terms") <= 1) & (F.col("lag") < LAG_OK), "consistent").otherwise("lagging"))


def overall(split_brain: Column, has_quorum: Column, degraded: Column) -> Column:
    return F.when(split_brain, "split_brain").when(~has_quorum, "no_quorum").when(degraded, "degraded").otherwise("healthy")


def probe_states(probes: DataFrame, failed_after: int = FAILED_AFTER, slot: int = 1_000_000) -> DataFrame:
    """``node, at, ok, failures, state, recovered`` from ``node, at, ok``: runs of failed probes.

    ``at`` is a whole number, unique per node.  A failure makes a node suspect, ``failed_after`` in
    a row failed; the first success after that is a recovery.  ``failures`` is the number of
    failures so far less that number at the last success, both running results by slots of
    ``slot``, so a node with very many probes is spread.
    """
    rows = probes.select("node", "at", "ok", block_of("at", slot).alias("slot"), (~F.col("ok")).cast("long").alias("bad"))
    rows = running_by_slots(rows, "node", "slot", ["at"], {"bad_so_far": ("sum", "bad")})
    rows = rows.withColumn("at_ok", F.when(F.col("ok"), F.col("bad_so_far")))
    # The success itself ends a run: for its recovery the last success before it counts.
    rows = running_by_slots(rows, "node", "slot", ["at"], {"upto": ("max", "at_ok")})
    previous = Window.partitionBy("node", "slot").orderBy("at")
    rows = rows.withColumn("failures", F.col("bad_so_far") - F.coalesce("upto", F.lit(0)))
    last_in_slot = rows.groupBy(F.col("node").alias("__n"), F.col("slot").alias("__s")).agg(F.max_by("failures", "at").alias("__f"))
    before_slot = last_in_slot.withColumn("__carry", F.lag("__f").over(Window.partitionBy("__n").orderBy("__s"))).drop("__f")
    rows = rows.join(before_slot, F.col("node").eqNullSafe(F.col("__n")) & (F.col("slot") == F.col("__s")))
    before = F.coalesce(F.lag("failures").over(previous), F.col("__carry"), F.lit(0))
    state = F.when(F.col("failures") == 0, "healthy").when(F.col("failures") < failed_after, "suspect").otherwise("failed")
    return rows.select("node", "at", "ok", "failures", state.alias("state"), (F.col("ok") & (before >= failed_after)).alias("recovered"))


def membership_changes(samples: DataFrame) -> DataFrame:
    """``at, node, change`` (added or removed) between neighbouring samples ``at, node``."""
    times = samples.select("at").distinct()
    w = Window.orderBy("at")  # one row per sample time
    order = times.withColumn("k", F.row_number().over(w))
    numbered = samples.distinct().join(order, "at")
    last = order.agg(F.max("k").alias("last")).first()[0] or 0
    nodes = numbered.select("node", "k")
    nxt = nodes.select(F.col("node").alias("n_node"), (F.col("k") - 1).alias("n_k"))
    gone = nodes.join(nxt, (F.col("node") == F.col("n_node")) & (F.col("k") == F.col("n_k")), "left_anti").where(F.col("k") < last).select((F.col("k") + 1).alias("k"), "node", F.lit("removed").alias("change"))
    prev = nodes.select(F.col("node").alias("p_node"), (F.col("k") + 1).alias("p_k"))
    new = nodes.join(prev, (F.col("node") == F.col("p_node")) & (F.col("k") == F.col("p_k")), "left_anti").where("k > 1").select("k", "node", F.lit("added").alias("change"))
    return gone.union(new).join(order, "k").select("at", "node", "change")
