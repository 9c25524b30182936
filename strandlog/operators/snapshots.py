"""Saved states of streams.  The table is append-only; of one (stream, version) the last save counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["stream_id", "version", "data", "metadata", "timestamp_ms"]


def current(snapshots: DataFrame) -> DataFrame:
    """One row per (stream, version): the save with the largest timestamp, of equal ones the largest data text."""
    order = F.struct("timestamp_ms", F.col("data"))
    rest = F.struct("data", "metadata", "timestamp_ms")
    one = snapshots.groupBy("stream_id", "version").agg(F.max_by(rest, order).alias("s"))
    return one.select("stream_id", "version", "s.data", "s.metadata", "s.timestamp_ms")


def save(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """The table after saving ``new`` rows; a later save of a (stream, version) stands for the earlier."""
    return current(snapshots.select(*COLUMNS).unionByName(new.select(*COLUMNS)))


def load(snapshots: DataFrame, stream_id: str | None = None) -> DataFrame:
    """The snapshot with the largest version of the stream, or of every stream."""
    rows = snapshots if stream_id is None else snapshots.where(F.col("stream_id") == stream_id)
    order = F.struct("version", "timestamp_ms", "data")
    one = rows.groupBy("stream_id").agg(F.max_by(F.struct("version", "data", "metadata", "timestamp_ms"), order).alias("s"))
    return one.select("stream_id", "s.version", "s.data", "s.metadata", "s.timestamp_ms")


def load_at(snapshots: DataFrame, stream_id: str, version: int) -> DataFrame:
    """The snapshot at exactly this version, or no row."""
    return current(snapshots.where((F.col("stream_id") == stream_id) & (F.col("version") == version)))


def list_snapshots(snapshots: DataFrame, stream_id: str, newest_first: bool = False) -> DataFrame:
    rows = current(snapshots.where(F.col("stream_id") == stream_id))
    return rows.orderBy(F.col("version").desc() if newest_first else "version")


def delete(snapshots: DataFrame, stream_id: str, version: int | None = None) -> DataFrame:
    """The table without the stream's snapshots, or without the one at ``version``."""
    gone = F.col("stream_id") == stream_id
    if version is not None:
        gone = gone & (F.col("version") == version)
    return snapshots.where(~F.coalesce(gone, F.lit(False)))


def exists(snapshots: DataFrame, stream_id: str, version: int | None = None) -> bool:
    rows = snapshots.where(F.col("stream_id") == stream_id)
    return not (rows if version is None else rows.where(F.col("version") == version)).isEmpty()


def sizes(snapshots: DataFrame) -> DataFrame:
    """``stream_id, snapshots, bytes`` of data text per stream; null data has none."""
    return current(snapshots).groupBy("stream_id").agg(F.count(F.lit(1)).alias("snapshots"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("bytes"))


def newest(snapshots: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` newest versions of each stream."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy(F.col("version").desc())
    return current(snapshots).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= keep).drop("__rn")
