"""Time travel: what a stream looked like at a clock reading (microseconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.text import wildcard_match
from strandlog.runtime import block_of, running_by_slots


def _options(rows: DataFrame, direction: str, limit: int | None) -> DataFrame:
    """Version order, turned round if backward, and only then cut: backward with a limit gives the newest."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction is 'forward' or 'backward'")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    version = F.col("version").desc() if direction == "backward" else F.col("version").asc()
    out = rows.orderBy("stream_id", version)
    return out if limit is None else out.limit(limit)


def _of(log: DataFrame, stream: str) -> DataFrame:
    return log.where(wildcard_match(F.col("stream_id"), stream, question_literal=True) if "*" in stream else F.col("stream_id") == stream)


def read_until(log: DataFrame, stream: str, at: int, direction: str = "forward", limit: int | None = None) -> DataFrame:
    """Events of a stream (or of a ``*`` pattern) with epoch_us up to and with ``at``, in version order."""
    return _options(_of(log, stream).where(F.col("epoch_us") <= at), direction, limit)


def read_range(log: DataFrame, stream: str, since: int, until: int, direction: str = "forward", limit: int | None = None) -> DataFrame:
    """Events with ``since <= epoch_us <= until``, in version order."""
    return _options(_of(log, stream).where(F.col("epoch_us").between(since, until)), direction, limit)


def version_at(log: DataFrame, stream_id: str, at: int) -> int:
    """Version of the last event by version whose clock is not after ``at``; -1 if none."""
    found = log.where((F.col("stream_id") == stream_id) & (F.col("epoch_us") <= at)).agg(F.max("version")).first()[0]
    return -1 if found is None else found


def versions_at(log: DataFrame, at: int) -> DataFrame:
    """``stream_id, version`` at ``at`` for every stream, -1 where it has no event yet."""
    return log.groupBy("stream_id").agg(F.coalesce(F.max(F.when(F.col("epoch_us") <= at, F.col("version"))), F.lit(-1).cast("long")).alias("version"))


def versions_as_of(log: DataFrame, requests: DataFrame, slot_us: int = 3_600_000_000) -> DataFrame:
    """An as-of join: for each request (``stream_id, at``) the largest version with epoch_us <= at, or -1.

    Clocks run back now and then, so the largest version up to a time is a running
    maximum over time, not the version of the latest reading, taken by slots of ``slot_us``
    so that no task sees a whole hot stream.  Repeated requests are answered once each; null ones with -1.
    """
    slot = block_of("at", slot_us)
    ask = requests.select("stream_id", "at").distinct()
    marks = log.select("stream_id", F.col("epoch_us").alias("at"), "version").where("stream_id is not null and at is not null").unionByName(ask.where("stream_id is not null and at is not null").select("stream_id", "at", F.lit(None).cast("long").alias("version")))
    marks = running_by_slots(marks.withColumn("slot", slot), "stream_id", "slot", ["at"], {"upto": ("max", "version")})
    answered = marks.where("version is null").select("stream_id", "at", F.coalesce("upto", F.lit(-1)).alias("version"))
    rest = ask.where("stream_id is null or at is null").select("stream_id", "at", F.lit(-1).cast("long").alias("version"))
    return answered.unionByName(rest)
