"""Links: named streams derived from others by a filter and a transformation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.text import wildcard_match
from strandlog.runtime import Scratch
from strandlog.shared_state import SharedState
from strandlog.sources.log import LINK_PREFIX


@dataclass(frozen=True)
class Source:
    """``type`` is stream, stream_pattern or all."""

    type: str
    stream_id: str | None = None
    pattern: str | None = None

    def predicate(self, stream: Column) -> Column:
        """Which streams the link takes from; ``all`` leaves out link streams, so links do not feed on links."""
        if self.type == "stream":
            return stream == self.stream_id
        if self.type == "stream_pattern":
            return wildcard_match(stream, self.pattern or "", question_literal=True)
        if self.type == "all":
            return ~stream.startswith(LINK_PREFIX)
        raise ValueError(f"unknown source type {self.type}")


@dataclass(frozen=True)
class Link:
    """``filter`` gives a boolean column for the event's columns; ``transform`` replaces columns by name."""

    name: str
    source: Source
    filter: Callable[[DataFrame], Column] | None = None
    transform: Callable[[DataFrame], dict[str, Column]] | None = None
    backfill: bool = False
    status: str = "stopped"
    created_at: int = 0
    processed: int = 0
    last_event: str | None = None

    @property
    def stream(self) -> str:
        return LINK_PREFIX + self.name


def selected(log: DataFrame, link: Link) -> DataFrame:
    """The events of the link's source that pass its filter, transformed; a null verdict is no."""
    rows = log.where(link.source.predicate(F.col("stream_id")))
    if link.filter is not None:
        rows = rows.where(link.filter(rows))
    if link.transform is not None:
        new = link.transform(rows)
        fixed = {"stream_id", "version", "event_id"} & set(new)
        if fixed:
            raise ValueError(f"a transformation keeps {sorted(fixed)}")
        rows = rows.withColumns(new)
    return rows


def copies(log: DataFrame, link: Link, first_version: int = 0) -> DataFrame:
    """The link stream's events: source events in (stream, version) order, numbered from ``first_version``.

    Id, type and data are kept, tags too; the metadata gets ``source_stream`` and
    ``source_version``, which win over keys of the event.  The rows are range-partitioned by
    (stream, version, id), so a hot source stream is spread, and written to the shared folder
    with their place in their partition; the numbers of rows per partition, as many as there
    are partitions, give every partition its first version.
    """
    spark = log.sparkSession
    scratch = Scratch(spark, "link")
    rows = selected(log, link).repartitionByRange("stream_id", "version", "event_id").sortWithinPartitions("stream_id", "version", "event_id")
    rows = scratch.write(rows.withColumn("__place", F.monotonically_increasing_id()), "rows")
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], first_version
    for p, n in counts:
        starts += [F.lit(p), F.lit(total)]
        total += n
    base = F.create_map(*starts)[part] if starts else F.lit(None).cast("long")
    origin = F.create_map(F.lit("source_stream"), F.col("stream_id"), F.lit("source_version"), F.col("version").cast("string"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("source_stream", "source_version"))
    keep = [c for c in log.columns if c not in ("stream_id", "version", "metadata")]
    return rows.select(F.lit(link.stream).alias("stream_id"), (base + place).cast("long").alias("version"), F.map_concat(kept, origin).alias("metadata"), *keep)


class LinkRegistry:
    """Definitions of links by name, and what became of them; durable if a folder is given."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self._state = SharedState(spark, path)

    def create(self, link: Link, created_at: int) -> Link:
        """Store a definition, stopped; one of the same name is replaced."""
        new = replace(link, status="stopped", created_at=created_at, processed=0)
        self._state.change(lambda links: links.update({link.name: new}))
        return new

    def get(self, name: str) -> Link:
        return self._state.read()[name]

    def list(self) -> list[Link]:
        return [x for _, x in sorted(self._state.read().items())]

    def delete(self, name: str) -> None:
        """Stop the link and forget it; the link stream stays."""
        self._state.change(lambda links: links.pop(name))

    def _set(self, name: str, edit: Callable[[Link], dict]) -> Link:
        def put(links: dict) -> Link:
            links[name] = replace(links[name], **edit(links[name]))
            return links[name]

        return self._state.change(put)

    def start(self, name: str) -> Link:
        return self._set(name, lambda _: {"status": "running"})

    def stop(self, name: str) -> Link:
        return self._set(name, lambda _: {"status": "stopped"})

    def processed(self, name: str, n: int, last_event: str | None = None) -> Link:
        return self._set(name, lambda old: {"processed": old.processed + n, "last_event": last_event or old.last_event})

    def info(self, name: str, log: DataFrame) -> dict:
        link = self.get(name)
        head = log.where(F.col("stream_id") == link.stream).agg(F.max("version")).first()[0]
        return {"name": name, "source": link.source, "status": link.status, "processed": link.processed, "created_at": link.created_at, "last_event": link.last_event, "stream": link.stream, "version": -1 if head is None else head}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(x.name, (x.source.type, x.source.stream_id, x.source.pattern), x.backfill, x.created_at, x.status, x.processed, x.last_event) for x in self.list()]
        return spark.createDataFrame(rows, "link_name string, source struct<type:string,stream_id:string,pattern:string>, backfill boolean, created_at long, status string, processed long, last_event string")


def link_matches(log: DataFrame, definitions: DataFrame) -> DataFrame:
    """``link_name, events, streams`` per stored definition, from one pass over the streams.

    ``definitions`` has ``link_name, source``.  Sources are few and go to the driver; counts
    per stream are made first, so every stream is matched once per definition, not every event.
    A definition without a usable source has 0.
    """
    links = definitions.select("link_name", "source.type", "source.stream_id", "source.pattern").collect()
    per_stream = log.where("stream_id is not null").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    hits = []
    for x in links:
        usable = (x.type == "stream" and x.stream_id is not None) or (x.type == "stream_pattern" and x.pattern is not None) or x.type == "all"
        rule = Source(x.type, x.stream_id, x.pattern).predicate(F.col("stream_id")) if usable else F.lit(False)
        hits.append(F.when(rule, F.lit(x.link_name)))
    if not hits:
        return definitions.select("link_name", F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("streams"))
    found = per_stream.select("n", F.explode(F.array_compact(F.array(*hits))).alias("link_name")).groupBy(F.col("link_name").alias("f_name")).agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("streams"))
    return definitions.select("link_name").join(found, F.col("link_name") == F.col("f_name"), "left").select("link_name", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("streams", F.lit(0)).alias("streams"))
