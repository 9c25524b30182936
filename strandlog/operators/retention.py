"""Cutting off the old part of streams: the plan for all streams at once, dry runs, archiving."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.text import wildcard_match
from strandlog.operators.archive import ArchiveBackend, key_column, make_key


@dataclass(frozen=True)
class Scavenge:
    """What to cut off.

    ``before_version`` cuts below that version and wins over ``before`` (microseconds),
    which cuts up to the version reached at that time, with it, or without it if
    ``exclusive``.  ``keep`` newest versions always stay.  Streams without a snapshot are left alone
    unless ``require_snapshot`` is off.
    """

    before: int | None = None
    before_version: int | None = None
    keep: int = 0
    require_snapshot: bool = True
    exclusive: bool = False


def plan(log: DataFrame, snapshots: DataFrame, options: Scavenge, pattern: str = "*", dry_run: bool = False, store: str | None = None) -> DataFrame:
    """``stream_id, status, deleted_count, from_version, to_version`` per stream that matches, from one pass.

    Status is ok or no_snapshot; streams without anything to cut have 0 and null
    versions.  With ``store`` an ``archive_key`` is added, with ``dry_run`` a constant column.
    """
    match = F.col("stream_id").isNotNull() if pattern == "*" else wildcard_match(F.col("stream_id"), pattern, question_literal=True)
    if options.before_version is not None:
        cutoff = F.lit(options.before_version - 1).cast("long")
    elif options.before is not None:
        inside = F.col("epoch_us") < options.before if options.exclusive else F.col("epoch_us") <= options.before
        cutoff = F.max(F.when(inside, F.col("version")))
    else:
        cutoff = F.lit(-1).cast("long")
    heads = log.where(match).groupBy("stream_id").agg(F.max("version").alias("head"), F.min("version").alias("tail"), F.coalesce(cutoff, F.lit(-1)).alias("cut"))
    upto = F.least("cut", F.col("head") - options.keep)
    heads = heads.select("stream_id", "tail", upto.alias("upto"))
    saved = snapshots.select(F.col("stream_id").alias("__saved")).distinct()
    heads = heads.join(saved, F.col("stream_id") == F.col("__saved"), "left")
    allowed = F.col("__saved").isNotNull() if options.require_snapshot else F.lit(True)
    # Versions are counted, not assumed dense: earlier cuts and gaps stay gaps.
    gone = log.join(heads.where(allowed).select(F.col("stream_id").alias("h_stream"), "upto"), (F.col("stream_id") == F.col("h_stream")) & (F.col("version") <= F.col("upto")))
    counted = gone.groupBy(F.col("stream_id").alias("c_stream")).agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("first"), F.max("version").alias("last"))
    out = heads.join(counted, F.col("stream_id") == F.col("c_stream"), "left")
    cols = ["stream_id", F.when(allowed, "ok").otherwise("no_snapshot").alias("status"), F.coalesce("n", F.lit(0)).alias("deleted_count"), F.col("first").alias("from_version"), F.col("last").alias("to_version")]
    if store is not None:
        cols.append(key_column(store, F.col("stream_id"), F.col("first"), F.col("last")).alias("archive_key"))
    if dry_run:
        cols.append(F.lit(True).alias("dry_run"))
    return out.select(*cols)


def scavenged(log: DataFrame, done: DataFrame) -> DataFrame:
    """The log without what a plan cuts off."""
    cut = done.where("deleted_count > 0").select(F.col("stream_id").alias("__s"), F.col("to_version").alias("__to"))
    return log.join(cut, (F.col("stream_id") == F.col("__s")) & (F.col("version") <= F.col("__to")), "left_anti")


def candidates(log: DataFrame, done: DataFrame) -> DataFrame:
    """The events that a plan cuts off."""
    cut = done.where("deleted_count > 0").select(F.col("stream_id").alias("__s"), F.col("to_version").alias("__to"))
    return log.join(cut, (F.col("stream_id") == F.col("__s")) & (F.col("version") <= F.col("__to")), "left_semi")


def archive_and_scavenge(log: DataFrame, snapshots: DataFrame, stream_id: str, options: Scavenge, backend: ArchiveBackend, store: str, dry_run: bool = False) -> tuple[DataFrame, dict]:
    """Archive what is cut off one stream, then give the log without it and a report.

    Nothing is archived in a dry run, without a snapshot, or if there is nothing to cut.
    """
    one = log.where(F.col("stream_id") == stream_id)
    found = plan(one, snapshots, options).collect()
    if not found:
        return log, {"stream_id": stream_id, "status": "stream_not_found"}
    r = found[0].asDict()
    report = r | {"archived": False, "archive_key": None, "dry_run": dry_run}
    if r["status"] != "ok" or not r["deleted_count"] or dry_run:
        return log, report
    key = make_key(store, stream_id, r["from_version"], r["to_version"])
    backend.archive(key, one.where(F.col("version") <= r["to_version"]))
    kept = log.where(~((F.col("stream_id") == stream_id) & (F.col("version") <= r["to_version"])) | F.col("stream_id").isNull())
    return kept, report | {"archived": True, "archive_key": key}
