"""A store: an append-only log under a folder, with optimistic concurrency and atomic appends.

Layout: ``data/<append>/`` Parquet of each append, ``commits/<n>.json`` naming it.  A commit file
is created exclusively, so of two writers with one number only one wins; data that no
commit names does not exist.  ``data/staged-*`` holds an append's rows until they have versions.  ``checkpoints/<n>.json`` names tables that stand for the first n
commits; a store object reads a commit file once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import snapshots as snap
from strandlog.operators.streams import WrongExpectedVersion, check_expected_version, with_defaults, without_deleted
from strandlog.runtime import create_exclusive, delete_path, full_uri, list_names, read_text
from strandlog.sources.log import ANY_VERSION, EVENT_SCHEMA, NO_STREAM, write_log

TOMBSTONE = "stream_id string, version long"
HEADS = "stream_id string, version long, floor long"
SNAPSHOT = "stream_id string, version long, data string, metadata map<string,string>, timestamp_ms long"
NEW_EVENT = "event_id string, event_type string, data string, metadata map<string,string>, tags array<string>"
RETRIES = 20


class Conflict(RuntimeError):
    """Another writer was first; nothing was written."""


class Store:
    def __init__(self, spark: SparkSession, path: str, name: str = "store"):
        self.spark, self.path, self.name = spark, full_uri(spark, path).rstrip("/"), name
        self._seen: dict[str, dict] = {}  # commit and checkpoint files never change

    # the commit log

    def _read(self, where: str) -> dict:
        if where not in self._seen:
            self._seen[where] = json.loads(read_text(self.spark, f"{self.path}/{where}"))
        return self._seen[where]

    def commits(self) -> list[dict]:
        """What the store holds: the newest checkpoint, if there is one, and the commits after it."""
        points = list_names(self.spark, f"{self.path}/checkpoints")
        base = [self._read(f"checkpoints/{points[-1]}")] if points else []
        first = f"{base[0]['upto']:012d}" if base else ""
        return base + [self._read(f"commits/{n}") for n in list_names(self.spark, f"{self.path}/commits") if n >= first]

    @staticmethod
    def _number(done: list[dict]) -> int:
        """The number of the next commit."""
        return sum(c["upto"] if c["kind"] == "base" else 1 for c in done)

    def _commit(self, number: int, entry: dict) -> bool:
        return create_exclusive(self.spark, f"{self.path}/commits/{number:012d}.json", json.dumps(entry))

    def _table(self, kind: str, schema, done: list[dict] | None = None) -> DataFrame:
        done = self.commits() if done is None else done
        folders = [c[kind] for c in done if c["kind"] == "base" and kind in c] + [c["folder"] for c in done if c["kind"] == kind]
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Write all live events, heads of streams and snapshots as tables of their own, and a checkpoint that names them.

        Appends may go on meanwhile; they come after the checkpoint.  Deleted events are gone
        from the new table, and the old files can go with ``vacuum``.
        """
        done = self.commits()
        upto = self._number(done)
        if upto == (done[0]["upto"] if done and done[0]["kind"] == "base" else 0):
            return
        mark = uuid.uuid4().hex
        write_log(self.log(done), f"{self.path}/data/base-{mark}")
        live = self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.path}/data/base-{mark}")
        dead = [(c["stream"], c["version"]) for c in done if c["kind"] == "delete"]
        heads = live.groupBy("stream_id").agg(F.max("version").alias("version")).select("stream_id", "version", F.lit(NO_STREAM).cast("long").alias("floor"))
        heads = heads.unionByName(self.spark.createDataFrame(dead, TOMBSTONE).select("stream_id", F.lit(NO_STREAM).cast("long").alias("version"), F.col("version").alias("floor")))
        heads = heads.unionByName(self._table("heads", HEADS, [c for c in done if c["kind"] == "base"]).where(F.col("floor") > NO_STREAM).withColumn("version", F.lit(NO_STREAM).cast("long")))
        heads.groupBy("stream_id").agg(F.max("version").alias("version"), F.max("floor").alias("floor")).repartitionByRange("stream_id").sortWithinPartitions("stream_id").write.parquet(f"{self.path}/data/heads-{mark}")
        snap.current(self._table("snapshot", SNAPSHOT, done)).write.parquet(f"{self.path}/data/snapshots-{mark}")
        entry = {"kind": "base", "upto": upto, "append": f"base-{mark}", "heads": f"heads-{mark}", "snapshot": f"snapshots-{mark}"}
        if not create_exclusive(self.spark, f"{self.path}/checkpoints/{upto:012d}.json", json.dumps(entry)):
            raise Conflict("another compaction was first")

    def vacuum(self) -> None:
        """Delete commit files and data that the newest checkpoint stands for; readers that began before it must have ended."""
        points = list_names(self.spark, f"{self.path}/checkpoints")
        if not points:
            return
        upto = self._read(f"checkpoints/{points[-1]}")["upto"]
        for name in list_names(self.spark, f"{self.path}/commits"):
            if name < f"{upto:012d}":
                delete_path(self.spark, f"{self.path}/data/{self._read(f'commits/{name}')['folder']}")
                delete_path(self.spark, f"{self.path}/commits/{name}")
        for name in points[:-1]:
            old = self._read(f"checkpoints/{name}")
            for folder in (old["append"], old["heads"], old["snapshot"]):
                delete_path(self.spark, f"{self.path}/data/{folder}")
            delete_path(self.spark, f"{self.path}/checkpoints/{name}")

    # reading

    def log(self, done: list[dict] | None = None) -> DataFrame:
        """All events of all streams that were not deleted."""
        done = self.commits() if done is None else done
        events = self._table("append", EVENT_SCHEMA, done)
        return without_deleted(events, self._table("delete", TOMBSTONE, done)) if any(c["kind"] == "delete" for c in done) else events

    def version(self, stream_id: str, done: list[dict] | None = None) -> int:
        """The last version from the commits' own notes and the checkpoint's heads, without reading events."""
        return self._head(stream_id, self.commits() if done is None else done)[0]

    def _head(self, stream_id: str, done: list[dict]) -> tuple[int, int]:
        """The last version, and the version up to which the stream was deleted."""
        head = floor = NO_STREAM
        for c in done:
            if c["kind"] == "base":
                where = f"heads {c['heads']} {stream_id}"
                if where not in self._seen:
                    r = self.spark.read.schema(HEADS).parquet(f"{self.path}/data/{c['heads']}").where(F.col("stream_id") == stream_id).first()
                    self._seen[where] = {"version": r.version, "floor": r.floor} if r else {"version": NO_STREAM, "floor": NO_STREAM}
                head, floor = self._seen[where]["version"], self._seen[where]["floor"]
            elif c["kind"] == "delete" and c["stream"] == stream_id:
                head, floor = NO_STREAM, max(floor, c["version"])
            elif c["kind"] == "append":
                head = max(head, c["heads"].get(stream_id, NO_STREAM))
        return head, floor

    # writing

    def append(self, stream_id: str, expected: int | str, events: Iterable[dict] | DataFrame, gateway: bool = False) -> int:
        """Append events to one stream; returns the last version.

        All events share one clock reading and become visible together or not at all.  An
        empty list returns the current version.  A writer that loses the race for a commit
        number checks its expectation against the new state and tries again.
        """
        new = events if isinstance(events, DataFrame) else self._frame(list(events))
        check_expected_version(expected, self.version(stream_id), gateway)  # before the work; it counts only below
        staged = f"staged-{uuid.uuid4().hex}"
        try:
            rows, counts = self._staged(new, staged)
            n = sum(k for _, k in counts)
            for _ in range(RETRIES):
                done = self.commits()
                current, floor = self._head(stream_id, done)
                check_expected_version(expected, current, gateway)
                if not n:
                    return current
                first = max(current, floor) + 1
                folder = f"append-{uuid.uuid4().hex}"
                self._numbered(rows, counts, stream_id, first).write.option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
                if self._commit(self._number(done), {"kind": "append", "folder": folder, "heads": {stream_id: first + n - 1}}):
                    return first + n - 1
            raise Conflict(f"no commit after {RETRIES} tries")
        finally:
            delete_path(self.spark, f"{self.path}/data/{staged}")

    def append_auto(self, stream_id: str, events) -> int:
        return self.append(stream_id, ANY_VERSION, events)

    def delete(self, stream_id: str) -> None:
        """Delete a stream and its events; a missing stream is no error.  Later appends go on behind the old versions."""
        done = self.commits()
        current = self.version(stream_id, done)
        if current == NO_STREAM:
            return
        folder = f"delete-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(stream_id, current)], TOMBSTONE).write.parquet(f"{self.path}/data/{folder}")
        if not self._commit(self._number(done), {"kind": "delete", "folder": folder, "stream": stream_id, "version": current}):
            raise Conflict("the store changed; try again")

    def _frame(self, events: list[dict]) -> DataFrame:
        rows = []
        for e in events:
            data = e["data"] if isinstance(e["data"], str) else json.dumps(e["data"], ensure_ascii=False, separators=(",", ":"))
            rows.append((e.get("event_id"), e["event_type"], data, e.get("metadata"), e.get("tags")))
        return self.spark.createDataFrame(rows, NEW_EVENT).coalesce(1) if rows else self.spark.createDataFrame([], NEW_EVENT)

    def _staged(self, new: DataFrame, folder: str) -> tuple[DataFrame, list[tuple[int, int]]]:
        """The rows written with their partition and their place in it, and the rows of each partition.

        The counts are those of the written table.  The plan of ``new`` run again for them, or for
        another try, may have other partitions: adaptive execution sizes them by the columns in use.
        """
        path = f"{self.path}/data/{folder}"
        rows = with_defaults(new).withColumn("__id", F.monotonically_increasing_id()).select("__id", "event_id", "event_type", "data", "metadata", "tags")
        rows.write.option("compression", "zstd").parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        part = F.shiftright("__id", 33)
        return rows, sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())

    def _numbered(self, rows: DataFrame, counts: list[tuple[int, int]], stream_id: str, first: int) -> DataFrame:
        """Versions of staged rows in the order they came in, by their partitions' counts."""
        clock = self.spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
        starts, total = [], first
        for p, n in counts:
            starts += [F.lit(p), F.lit(total).cast("long")]
            total += n
        return rows.select(
            F.lit(stream_id).alias("stream_id"), (F.create_map(*starts)[part] + place).cast("long").alias("version"), "event_id", "event_type", "data", "metadata", "tags",
            F.lit(clock // 1000).cast("long").alias("timestamp_ms"), F.lit(clock).cast("long").alias("epoch_us"), F.col("metadata")["causation_id"].alias("causation_id"), F.col("metadata")["correlation_id"].alias("correlation_id"),
        )

    # snapshots

    def snapshots(self) -> DataFrame:
        return snap.current(self._table("snapshot", SNAPSHOT))

    def save_snapshot(self, stream_id: str, version: int, data: dict | str, metadata: dict | None = None) -> None:
        clock = self.spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0]
        text = data if isinstance(data, str) else json.dumps(data, ensure_ascii=False, separators=(",", ":"))
        for _ in range(RETRIES):
            folder = f"snapshot-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(stream_id, version, text, metadata or {}, clock)], SNAPSHOT).coalesce(1).write.parquet(f"{self.path}/data/{folder}")
            if self._commit(self._number(self.commits()), {"kind": "snapshot", "folder": folder}):
                return
        raise Conflict("the store changed; try again")


class StoreCatalog:
    """The stores of one driver by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self._stores = spark, {}

    def start(self, name: str, path: str) -> Store:
        return self._stores.setdefault(name, Store(self.spark, path, name))

    def stop(self, name: str) -> None:
        self._stores.pop(name, None)

    def get(self, name: str) -> Store:
        return self._stores[name]

    def list(self) -> list[str]:
        return sorted(self._stores)


__all__ = ["Conflict", "Store", "StoreCatalog", "WrongExpectedVersion"]
