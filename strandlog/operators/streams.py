"""Reads over the log: one stream by version, all streams by type or tag, and what streams there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.sources.log import ANY_VERSION, NO_STREAM, VERSION_DIGITS

#: Order across streams: clocks tie, so stream and version decide.
GLOBAL_ORDER = ("epoch_us", "stream_id", "version")


class StreamNotFound(LookupError):
    pass


class WrongExpectedVersion(ValueError):
    def __init__(self, expected, current: int):
        super().__init__(f"expected version {expected}, stream is at {current}")
        self.expected, self.current = expected, current


def _direction(direction: str) -> bool:
    if direction not in ("forward", "backward"):
        raise ValueError("direction is 'forward' or 'backward'")
    return direction == "backward"


def require_stream(log: DataFrame, stream_id: str) -> None:
    if not exists(log, stream_id):
        raise StreamNotFound(stream_id)


def read(log: DataFrame, stream_id: str, start: int, count: int, direction: str = "forward") -> DataFrame:
    """Events of one stream, versions ``start`` to ``start + count - 1`` ascending, or downwards from ``start``.

    Versions that do not exist are skipped.  ``require_stream`` tells a missing stream from an
    empty range.
    """
    back = _direction(direction)
    low, high = (max(0, start - count + 1), start) if back else (start, start + count - 1)
    order = F.col("version").desc() if back else F.col("version").asc()
    return log.where((F.col("stream_id") == stream_id) & F.col("version").between(low, high)).orderBy(order)


def read_all(log: DataFrame, stream_id: str, count: int, direction: str = "forward") -> DataFrame:
    """The first ``count`` events of a stream from its beginning, or from its head when backward."""
    back = _direction(direction)
    return log.where(F.col("stream_id") == stream_id).orderBy(F.col("version").desc() if back else "version").limit(count)


def scan_all(log: DataFrame, limit: int | None = None) -> DataFrame:
    """All events of all streams in global order."""
    out = log.orderBy(*GLOBAL_ORDER)
    return out if limit is None else out.limit(limit)


def read_by_event_types(log: DataFrame, types: list[str], limit: int | None = None) -> DataFrame:
    """Events of the given types over all streams by time; no types means every event."""
    rows = log.where(F.col("event_type").isin(types)) if types else log
    return scan_all(rows, limit)


def tag_match(tags: Column, wanted: list[str], match: str = "any") -> Column:
    """Has the event one (any) or each (all) of the tags?  No wanted tags match nothing; no tags are never matched."""
    if match not in ("any", "all"):
        raise ValueError("match is 'any' or 'all'")
    if not wanted:
        return F.lit(False)
    literal = F.array(*[F.lit(t) for t in dict.fromkeys(wanted)])
    hit = F.arrays_overlap(tags, literal) if match == "any" else F.size(F.array_except(literal, tags)) == 0
    return F.coalesce(tags.isNotNull() & hit, F.lit(False))


def read_by_tags(log: DataFrame, wanted: list[str], match: str = "any", limit: int | None = None) -> DataFrame:
    return scan_all(log.where(tag_match(F.col("tags"), wanted, match)), limit)


def tag_index(log: DataFrame) -> DataFrame:
    """``tag, stream_id, version``: a table to write sorted by tag, against which tag reads become semi-joins."""
    return log.select(F.explode("tags").alias("tag"), "stream_id", "version").where("tag is not null").distinct()


def versions(log: DataFrame) -> DataFrame:
    """``stream_id, version, events`` of every stream: its last version (gaps and cut-off beginnings do not matter)."""
    return log.groupBy("stream_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("events"))


def get_version(log: DataFrame, stream_id: str) -> int:
    """The last version of a stream, -1 if there is none."""
    found = log.where(F.col("stream_id") == stream_id).agg(F.max("version")).first()[0]
    return NO_STREAM if found is None else found


def exists(log: DataFrame, stream_id: str) -> bool:
    return bool(log.where(F.col("stream_id") == stream_id).select(F.lit(1)).take(1))


def existing(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (column stream_id) with a boolean ``found``, in one pass over the log."""
    there = log.select(F.col("stream_id").alias("__there")).where("__there is not null").distinct()
    return wanted.join(there, F.col("stream_id") == F.col("__there"), "left").select(*[wanted[c] for c in wanted.columns], F.col("__there").isNotNull().alias("found"))


def list_streams(log: DataFrame) -> DataFrame:
    return log.select("stream_id").where("stream_id is not null").distinct().orderBy("stream_id")


def version_accepted(expected: Column, current: Column, dialect: str = "store") -> Column:
    """May an append that expects ``expected`` go on at version ``current``?

    Dialect "store": -1 wants an empty stream, -2 anything, other numbers equality.  Dialect
    "gateway", with ``expected`` as text: "any", "stream_exists", or a number, 0 also
    accepting an empty stream.
    """
    if dialect == "store":
        return (expected == ANY_VERSION) | (expected == current)
    if dialect == "gateway":
        number = expected.try_cast("long")
        return (expected == "any") | ((expected == "stream_exists") & (current >= 0)) | F.coalesce(((number == 0) & (current == NO_STREAM)) | (number == current), F.lit(False))
    raise ValueError("dialect is 'store' or 'gateway'")


def check_expected_version(expected: int | str, current: int, gateway: bool = False) -> None:
    """Raise ``WrongExpectedVersion`` unless the append may go on.  Gateway words: "any", "stream_exists"."""
    if gateway:
        ok = expected == "any" or (expected == "stream_exists" and current >= 0) or (expected == 0 and current == NO_STREAM) or expected == current
    else:
        ok = expected == ANY_VERSION or expected == current
    if not ok:
        raise WrongExpectedVersion(expected, current)


def padded(version: Column, digits: int = VERSION_DIGITS) -> Column:
    """Zero-padded, so that text order is number order; longer numbers are not cut."""
    text = version.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def with_defaults(new_events: DataFrame) -> DataFrame:
    """New events with what an append fills in: an id, empty metadata, content types."""
    have = set(new_events.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return new_events.select(
        F.coalesce(col("event_id", "string"), F.uuid()).alias("event_id"),
        "event_type",
        "data",
        F.coalesce(col("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
        col("tags", "array<string>").alias("tags"),
        F.lit("application/json").alias("data_content_type"),
        F.lit("application/json").alias("metadata_content_type"),
    )


def without_deleted(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The log without events up to the version at which their stream was deleted (``stream_id, version``)."""
    last = tombstones.groupBy("stream_id").agg(F.max("version").alias("__upto")).withColumnRenamed("stream_id", "__gone")
    return log.join(last, (F.col("stream_id") == F.col("__gone")) & (F.col("version") <= F.col("__upto")), "left_anti")
