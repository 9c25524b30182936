"""Documents into fixed windows of several sizes, hardly any room left, none split that fits."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.tokenizer import VOCABULARY, VOCABULARY_DIR, count_tokens
from strandlog.runtime import Scratch, fields

TIERS = (512, 2048, 8192)
#: Windows of the largest size that make one step group; smaller windows count by their size.
GROUP_WINDOWS = 4


@dataclass
class PackingPlan:
    """Which ranks of each length go to which windows; its size depends on the tiers, not on the data.

    Items of one length are interchangeable, so a run says: ranks ``rank_from`` to before
    ``rank_to`` of ``length`` lie one each in the windows from ``window_from`` on, at token
    ``offset`` and place ``slot``.
    """

    length: list[int] = field(default_factory=list)
    rank_from: list[int] = field(default_factory=list)
    rank_to: list[int] = field(default_factory=list)
    window_from: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    slot: list[int] = field(default_factory=list)
    #: (tier, first window, number of windows), largest tier first
    tiers: list[tuple[int, int, int]] = field(default_factory=list)


def plan_windows(histogram: dict[int, int], tiers=TIERS) -> PackingPlan:
    """Pack a histogram of lengths (1 to the largest tier) by best fit over descending lengths.

    The longest tier is packed first with the items routed to it.  Items of the next
    shorter tier first fill the gaps that are left in longer windows, each the tightest
    one it fits, and then windows of their own; and so on down to the shortest.
    Equal windows are handled as one group, so the work depends on the number of different
    lengths, not on the number of items.
    """
    sizes = sorted(tiers, reverse=True)
    if not sizes or sizes[-1] < 1 or any(not 1 <= n <= sizes[0] for n in histogram):
        raise ValueError("lengths lie between 1 and the largest tier")
    plan = PackingPlan()
    gaps: list[int] = []  # gaps that occur, ascending
    groups: dict[int, list[tuple[int, int, int, int]]] = {}  # gap -> (first window, windows, used, items)
    windows = 0

    def put(gap: int, group) -> None:
        if gap:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append(group)

    for k, tier in enumerate(sizes):
        below = sizes[k + 1] if k + 1 < len(sizes) else 0
        first = windows
        for length in sorted((n for n in histogram if below < n <= tier), reverse=True):
            left, rank = histogram[length], 0
            while left:
                at = bisect_left(gaps, length)
                if at == len(gaps):
                    new = -(-left // (tier // length))
                    put(tier, (windows, new, 0, 0))
                    windows += new
                    continue
                gap = gaps[at]
                start, count, used, items = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(at)
                taken = min(left, count)
                for column, v in zip((plan.length, plan.rank_from, plan.rank_to, plan.window_from, plan.offset, plan.slot), (length, rank, rank + taken, start, used, items)):
                    column.append(v)
                put(gap - length, (start, taken, used + length, items + 1))
                if count > taken:
                    put(gap, (start + taken, count - taken, used, items))
                left, rank = left - taken, rank + taken
        plan.tiers.append((tier, first, windows - first))
    return plan


_ITEM = "piece int, first_token long, n_tokens long, part int, local_rank long"


def _items(capacity: int):
    """Cut what exceeds the capacity and rank the items of each length within the task."""

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, ranks = TaskContext.get().partitionId(), {}
        for b in batches:
            rows, out = [], ([], [], [], [])
            for r, n in enumerate(b.column("total").to_pylist()):
                for piece, a in enumerate(range(0, n, capacity) if n else (0,)):
                    size = min(capacity, n - a)
                    rank = ranks.get(size, 0)
                    ranks[size] = rank + 1
                    rows.append(r)
                    for column, v in zip(out, (piece, a, size, rank)):
                        column.append(v)
            piece, first, size, rank = out
            columns = [b.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.record_batch(columns, names=["id", "piece", "first_token", "n_tokens", "part", "local_rank"])

    return work


def _place(plan, group_windows: int):
    """Look up the window of each (length, rank) by binary search in the plan."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        p = plan.value
        length, low, window, offset, slot = (np.array(x, np.int64) for x in (p.length, p.rank_from, p.window_from, p.offset, p.slot))
        order = np.lexsort((low, length))
        length, low, window, offset, slot = (x[order] for x in (length, low, window, offset, slot))
        lengths, starts = np.unique(length, return_index=True)
        ends = np.append(starts[1:], len(length))
        largest, tiers, first_group = p.tiers[0][0], [], 0
        for tier, first, count in p.tiers:
            groups = -(-count // (group_windows * (largest // tier)))
            tiers.append((tier, first, count, groups, first_group))
            first_group += groups
        for b in batches:
            n, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            at = np.full(len(n), -1)
            for v in np.unique(n):
                if v:
                    k = np.searchsorted(lengths, v)
                    rows = np.flatnonzero(n == v)
                    at[rows] = starts[k] + np.searchsorted(low[starts[k] : ends[k]], rank[rows], "right") - 1
            none = at < 0
            i = np.maximum(at, 0)
            w = window[i] + rank - low[i] if len(window) else np.zeros(len(n), np.int64)
            size, group = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for tier, first, count, groups, base in tiers:
                own = (w >= first) & (w < first + count)
                size[own], group[own] = tier, base + (w[own] - first) % max(groups, 1)
            put = lambda x: pa.array(x, pa.int64(), mask=none)
            offs, slots = (offset[i], slot[i]) if len(window) else (w, w)
            yield pa.record_batch([*(b.column(c) for c in ("id", "piece", "first_token", "n_tokens")), put(size), put(w), put(slots), put(offs), put(group)], names=_PLACED)

    return work


_PLACED = ["id", "piece", "first_token", "n_tokens", "window_tokens", "window_id", "slot", "window_offset", "step_group"]


def pack_documents(df: DataFrame, id_col: str, text_col: str, tiers=TIERS, group_windows: int = GROUP_WINDOWS, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """One row per document, or per piece of one longer than the largest tier, with its window.

    Columns: ``id_col, piece, first_token, n_tokens`` (the tokens of the document that the
    row holds), ``window_tokens`` (the window's capacity), ``window_id, slot, window_offset``
    (where it lies) and ``step_group`` (windows trained together: of one capacity, each group
    with the same number of windows but for one, dealt so that fuller and emptier ones mix).
    A document of up to the largest tier is never split; a longer one gives full pieces and a
    rest.  Null and empty texts take no room: one row with 0 tokens and null window columns.
    Rows with repeated or null ids are packed as they come.  ``tiers`` should divide each other.

    Only the histogram of lengths comes to the driver (at most one entry per token of the
    largest tier), where all windows are planned at once; documents get numbers within their
    length from counts per task and find their window in the plan.  The plan's size is a
    matter of the tiers alone.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    capacity = max(tiers)
    sized = count_tokens(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", directory, name).withColumnRenamed("n_tokens", "total")
    id_field = T.StructField("id", df.schema[id_col].dataType)
    items = scratch.write(sized.mapInArrow(_items(capacity), T.StructType([id_field, *fields(_ITEM)])), "items")
    per_part = items.groupBy("part", "n_tokens").agg((F.max("local_rank") + 1).alias("n"))
    per_part = scratch.write(per_part, "counts")
    histogram = {r.n_tokens: r.n for r in per_part.where("n_tokens > 0").groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_windows(histogram, tiers))
    # A length has one row per map task here, however many documents have that length.
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per_part.select(F.col("part").alias("b_part"), F.col("n_tokens").alias("b_n"), F.coalesce(before, F.lit(0)).alias("base"))
    ranked = items.join(base, (F.col("part") == F.col("b_part")) & (F.col("n_tokens") == F.col("b_n"))).withColumn("rank", F.col("base") + F.col("local_rank"))
    placed = T.StructType([id_field, T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in _PLACED[2:]]])
    out = ranked.select("id", "piece", "first_token", "n_tokens", "rank").mapInArrow(_place(plan, group_windows), placed)
    return out.withColumnRenamed("id", id_col)


def window_fill(packed: DataFrame) -> DataFrame:
    """Per capacity: windows, items, tokens held, the share of room used and the spread of tokens per step group."""
    used = packed.where("window_id IS NOT NULL")
    windows = used.groupBy("window_tokens", "step_group", "window_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("items"))
    groups = windows.groupBy("window_tokens", "step_group").agg(F.sum("held").alias("held"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("windows"))
    return groups.groupBy("window_tokens").agg(
        F.sum("windows").alias("windows"), F.sum("items").alias("items"), F.sum("held").alias("tokens"), (F.sum("held") / (F.sum("windows") * F.col("window_tokens"))).alias("fill"), F.count(F.lit(1)).alias("step_groups"), F.min("held").alias("least_in_group"), F.max("held").alias("most_in_group")
    )
