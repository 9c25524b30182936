"""Live delivery with Structured Streaming: subscriptions, links and running folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlog.operators import fold, links, subscriptions
from strandlog.runtime import create_exclusive, list_names, read_text
from strandlog.sources.log import EVENT_SCHEMA


def log_stream(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """The log's Parquet folder as a stream; the limits bound a micro-batch, which is this engine's backpressure."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def _start(stream: DataFrame, handler: Callable[[DataFrame, int], None], name: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(handler)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deliver(stream: DataFrame, kind: str, selector, handler: Callable[[DataFrame, int], None], name: str, checkpoint: str, start_from: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Run a subscription: ``handler(events, batch)`` gets each micro-batch of matching events.

    Delivery is at least once; (stream_id, version) tells repeats.  ``start_from`` leaves out lower
    versions, also of what lay in the folder before: catching up and going on are one query.
    """
    rows = subscriptions.matching(stream, kind, selector)
    if start_from is not None:
        rows = rows.where(F.col("version") >= start_from)
    return _start(rows, handler, name, checkpoint, available_now)


def run_link(stream: DataFrame, link: links.Link, out: str, checkpoint: str, registry: links.LinkRegistry | None = None, available_now: bool = False) -> StreamingQuery:
    """Run a link: each micro-batch becomes the next versions of the link stream under ``out``.

    A batch is written to a folder of its own number and replaces what a failed attempt
    left there, so a batch that runs again leaves no repeats.
    """
    spark = stream.sparkSession
    heads = f"{out}/_heads"  # a name that readers of the folder pass over

    def write(batch: DataFrame, number: int) -> None:
        earlier = [n for n in list_names(spark, heads) if n < f"{number:012d}"]
        before = int(read_text(spark, f"{heads}/{earlier[-1]}")) if earlier else 0
        links.copies(batch, link, before).write.mode("overwrite").parquet(f"{out}/batch={number}")
        n = spark.read.parquet(f"{out}/batch={number}").count()
        # The batch that runs again finds its own note, which says the same.
        if create_exclusive(spark, f"{heads}/{number:012d}", str(before + n)) and registry is not None:
            registry.processed(link.name, n)

    return _start(stream, write, f"link-{link.name}", checkpoint, available_now)


class Runner:
    """Starts and stops the queries of stored subscriptions and links over one log folder.

    The definitions and every query's checkpoint lie under ``path``, so a new driver goes on
    where the last one stopped.  A query that was running when its driver ended is started
    again by ``resume``.
    """

    def __init__(self, spark: SparkSession, log: str, path: str):
        self.spark, self.log, self.path = spark, log, path.rstrip("/")
        self.links = links.LinkRegistry(spark, f"{self.path}/links")
        self.subscriptions = subscriptions.SubscriptionRegistry(spark, f"{self.path}/subscriptions")
        self.queries: dict[str, StreamingQuery] = {}

    def _end(self, key: str) -> None:
        query = self.queries.pop(key, None)
        if query is not None:
            query.stop()

    def start_link(self, name: str, available_now: bool = False) -> StreamingQuery:
        """Run a stored link; without ``backfill`` only what comes after its creation."""
        self._end(f"link {name}")
        link = self.links.start(name)
        stream = log_stream(self.spark, self.log)
        if not link.backfill:
            stream = stream.where(F.unix_millis("_metadata.file_modification_time") >= link.created_at)
        self.queries[f"link {name}"] = query = run_link(stream.select(*EVENT_SCHEMA.names), link, self.link_path(name), f"{self.path}/checkpoints/link-{name}", self.links, available_now)
        return query

    def link_path(self, name: str) -> str:
        return f"{self.path}/link-streams/{name}"

    def stop_link(self, name: str) -> None:
        self._end(f"link {name}")
        self.links.stop(name)

    def delete_link(self, name: str) -> None:
        self.stop_link(name)
        self.links.delete(name)

    def subscribe(self, kind: str, selector, name: str, handler: Callable[[DataFrame, int], None], start_from: int | None = None, available_now: bool = False) -> str:
        """Store a subscription and start its delivery; returns its key."""
        key = self.subscriptions.subscribe(kind, selector, name, start_from=start_from)
        self.start_subscription(key, handler, available_now)
        return key

    def start_subscription(self, key: str, handler: Callable[[DataFrame, int], None], available_now: bool = False) -> StreamingQuery:
        """Start, or after a change of the definition restart, the delivery of a stored subscription."""
        self._end(f"subscription {key}")
        sub = self.subscriptions.get(key)
        self.queries[f"subscription {key}"] = query = deliver(log_stream(self.spark, self.log), sub.type, sub.selector, handler, f"subscription-{key}", f"{self.path}/checkpoints/subscription-{key}", sub.checkpoint, available_now)
        return query

    def unsubscribe(self, key: str) -> None:
        self._end(f"subscription {key}")
        self.subscriptions.unsubscribe(key)

    def resume(self, handlers: dict[str, Callable[[DataFrame, int], None]] | None = None) -> None:
        """Start every link stored as running, and the subscriptions a handler is given for by key."""
        for x in self.links.list():
            if x.status == "running" and f"link {x.name}" not in self.queries:
                self.start_link(x.name)
        for key, handler in (handlers or {}).items():
            self.start_subscription(key, handler)

    def close(self) -> None:
        """Stop all queries; the stored states stay, for ``resume``."""
        for key in list(self.queries):
            self._end(key)


def running_totals(stream: DataFrame, field: str) -> DataFrame:
    """Running count, last version and total of a numeric field per stream, kept in the query's state."""
    value = fold.field_number(fold.data_fields(F.col("data"))[field])
    return stream.withColumn("__v", value).groupBy("stream_id").agg(F.count(F.lit(1)).alias("events"), F.max("version").alias("last_version"), F.sum("__v").alias("total"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and time window, closed once the watermark has passed."""
    timed = stream.withColumn("at", F.timestamp_micros("epoch_us")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("events"))


def running_fold(stream: DataFrame) -> DataFrame:
    """The tagged fold as a stateful stream: after each batch the state ``group, field, number, value`` of changed keys.

    Events of one (group, field) are folded in position order inside a batch, batches in their
    order; the state of a key is one exact number, as text, and one text.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    ops = fold.fold_ops(stream).select("group", "field", "position", text("delta"), "set_to", text("set_number"))

    def update(key, frames, state):
        from decimal import Decimal

        import pandas as pd

        number, value, has = state.get if state.exists else ("0", None, False)
        rows = pd.concat(list(frames)).sort_values("position").reset_index(drop=True)
        sets = rows.index[rows["delta"].isna()]
        if len(sets):
            last = rows.loc[sets[-1]]
            has = isinstance(last["set_number"], str)
            number, value = (last["set_number"] if has else "0"), last["set_to"]
            rows = rows.loc[sets[-1] + 1 :]
        if len(rows):
            number, value, has = str(sum(map(Decimal, rows["delta"]), Decimal(number))), None, True
        state.update((number, value, has))
        yield pd.DataFrame({"group": [key[0]], "field": [key[1]], "number": [number if has else None], "value": [value]})

    out = ops.groupBy("group", "field").applyInPandasWithState(update, "group string, field string, number string, value string", "number string, value string, has boolean", "update", "NoTimeout")
    return out.withColumn("number", F.col("number").cast(fold.NUMBER))
