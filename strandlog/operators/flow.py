"""Flow control: bounded queues with overflow rules, on single items and on whole batches."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("drop_oldest", "drop_newest", "block", "error")


class Blocked(RuntimeError):
    pass


class QueueFull(RuntimeError):
    pass


class BoundedQueue:
    """First in, first out, at most ``max_queue`` items.

    ``warn`` is called with the size when an item comes in at or above ``warning_threshold``
    (a share).  Demand is without limit in push mode and starts at 0 in pull mode;
    taking items lowers it, and limits what is taken only if ``limit_to_demand`` is set.
    """

    def __init__(self, max_queue: int = 1000, strategy: str = "drop_oldest", mode: str = "push", warning_threshold: float = 0.8, warn: Callable[[int], None] | None = None, limit_to_demand: bool = False):
        if strategy not in STRATEGIES or mode not in ("push", "pull"):
            raise ValueError("unknown strategy or mode")
        self.max_queue, self.strategy, self.mode = max_queue, strategy, mode
        self.warning_at = int(max_queue * warning_threshold)
        self._warn, self._limit, self._items, self.dropped = warn, limit_to_demand, deque(), 0
        self.demand: float = math.inf if mode == "push" else 0

    def enqueue(self, item) -> None:
        if self._warn and len(self._items) >= self.warning_at:
            self._warn(len(self._items))
        if len(self._items) >= self.max_queue:
            if self.strategy == "block":
                raise Blocked
            if self.strategy == "error":
                raise QueueFull
            self.dropped += 1
            if self.strategy == "drop_newest":
                return
            self._items.popleft()
        self._items.append(item)

    def enqueue_many(self, items: Iterable) -> int:
        """Put in items until one is refused; returns how many went in before it was raised to the caller."""
        n = 0
        for x in items:
            self.enqueue(x)
            n += 1
        return n

    def dequeue(self, n: int = 1) -> list:
        n = min(n, len(self._items))
        if self._limit and self.demand < n:
            n = int(self.demand)
        out = [self._items.popleft() for _ in range(n)]
        self.demand = max(0, self.demand - n)
        return out

    def dequeue_all(self) -> list:
        return self.dequeue(len(self._items))

    def set_demand(self, n: float) -> None:
        self.demand = n

    def add_demand(self, n: int) -> None:
        self.demand += n

    @property
    def size(self) -> int:
        return len(self._items)

    @property
    def is_empty(self) -> bool:
        return not self._items

    @property
    def is_full(self) -> bool:
        return len(self._items) >= self.max_queue

    def info(self) -> dict:
        return {"size": self.size, "max_queue": self.max_queue, "strategy": self.strategy, "mode": self.mode, "dropped": self.dropped, "demand": self.demand, "utilization": self.size / self.max_queue if self.max_queue else 0.0, "warning_at": self.warning_at}


def bounded_batch(rows: DataFrame, queue: list[str], order: list[str], max_queue: int, strategy: str = "drop_oldest") -> DataFrame:
    """What a bounded queue per key would hold after taking a whole batch in ``order``.

    drop_oldest leaves the last ``max_queue`` rows of each key, drop_newest, block and error the
    first.  Ties are decided by all order columns together, which should be unique.  Ranking stops
    at the limit, so a hot key's task keeps only that many rows of its input partitions.
    """
    if strategy not in STRATEGIES:
        raise ValueError("unknown strategy")
    down = strategy == "drop_oldest"
    w = Window.partitionBy(*queue).orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c in order])
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_queue).drop("__rn")


def overflow(rows: DataFrame, queue: list[str], max_queue: int, warning_threshold: float = 0.8) -> DataFrame:
    """Per key: rows offered, held, dropped, utilization, and whether the warning line was reached."""
    out = rows.groupBy(*queue).agg(F.count(F.lit(1)).alias("offered"))
    held = F.least(F.col("offered"), F.lit(max_queue))
    return out.select(*queue, "offered", held.alias("held"), (F.col("offered") - held).alias("dropped"), (held / F.lit(float(max_queue))).alias("utilization"), (F.col("offered") > int(max_queue * warning_threshold)).alias("warned"))


@dataclass
class MemoryLevels:
    """Memory pressure by the share used, with callbacks on change."""

    elevated: float = 0.70
    critical: float = 0.85
    level: str = "normal"

    def __post_init__(self):
        self._callbacks: list[Callable[[str], None]] = []

    def level_of(self, used: float) -> str:
        return "critical" if used >= self.critical else "elevated" if used >= self.elevated else "normal"

    def column(self, used: Column) -> Column:
        return F.when(used >= self.critical, "critical").when(used >= self.elevated, "elevated").otherwise("normal")

    def on_change(self, callback: Callable[[str], None]) -> Callable[[str], None]:
        self._callbacks.append(callback)
        return callback

    def remove(self, callback: Callable[[str], None]) -> None:
        self._callbacks.remove(callback)

    def check(self, used: float) -> str:
        new = self.level_of(used)
        if new != self.level:
            self.level = new
            for f in self._callbacks:
                f(new)
        return new
