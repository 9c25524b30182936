"""The canonical event log: one row per event, whatever the delivery looked like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.runtime import fields, numbered_within
from strandlog.sources.tables import table

#: Columns of the canonical log.  ``data`` is JSON text; ``timestamp_ms`` and ``epoch_us`` are server clocks.
EVENT_SCHEMA = fields(
    "stream_id string, version long, event_id string, event_type string, data string, metadata map<string,string>, tags array<string>, "
    "timestamp_ms long, epoch_us long, causation_id string, correlation_id string"
)
COLUMNS = EVENT_SCHEMA.names

NO_STREAM, ANY_VERSION = -1, -2
LINK_PREFIX = "$link:"
VERSION_DIGITS = 12


#: What an event id stands for in the event_log table: the same in every delivery of an event.
FIXED = ("event_id", "stream_id", "version", "event_type", "causation_id", "correlation_id")


def canonical(deliveries: DataFrame, columns: list[str] | None = None, time_col: str = "epoch_us", order_col: str = "delivery_id", fixed: tuple[str, ...] = ()) -> DataFrame:
    """One row per event id: the delivery with the smallest (time, order).

    Only ``columns`` are carried.  Copies are reduced where they are read before any exchange, so
    an event delivered very often costs no task more than others.  Rows with a null event
    id are dropped as no events.

    ``fixed`` names columns that are known to be the same in every delivery of an event.  They
    are grouped by, so that later conditions on them reach the scan, and only what differs
    between deliveries is chosen; contradicting deliveries would then stay as several rows.
    """
    wanted = columns or COLUMNS
    keys = ["event_id", *[c for c in fixed if c in wanted and c != "event_id"]]
    rest = [c for c in wanted if c not in keys]
    rows = deliveries.where(F.col("event_id").isNotNull())
    if not rest:
        return rows.select(*keys).distinct().select(*wanted)
    if rest == [time_col]:
        return rows.groupBy(*keys).agg(F.min(time_col).alias(time_col)).select(*wanted)
    order = F.struct(F.col(time_col).isNull(), F.col(time_col), F.col(order_col))
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__one"))
    return one.select(*[F.col(f"__one.`{c}`").alias(c) if c in rest else F.col(c) for c in wanted])


def event_log(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The canonical log over the ``event_log`` table of a folder."""
    return canonical(table(spark, folder, "event_log"), columns, fixed=FIXED)


def from_user_events(events: DataFrame) -> DataFrame:
    """The ``events`` table (a plain feed of user actions) as a log: one stream per user in time order."""
    return numbered_within(events, "user_id", ["ts", "event_id"], "__version").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream_id"),
        F.col("__version").alias("version"),
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        F.to_json(F.struct(F.col("value"), F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("data"),
        F.create_map(F.lit("schema_version"), (F.col("event_id") % 3 + 1).cast("string")).alias("metadata"),
        F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("type:"), F.col("event_type"))).alias("tags"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("epoch_us"),
        F.when(F.col("event_id") % 10 != 0, (F.col("event_id") - F.col("event_id") % 7 - 1).cast("string")).alias("causation_id"),
        F.expr("cast(event_id div 20 as string)").alias("correlation_id"),
    )


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A log from files of any format Spark reads; JSON lines are read with the log's own schema."""
    reader = spark.read.format(fmt)
    return (reader.schema(EVENT_SCHEMA) if fmt == "json" else reader).load(path)


def write_log(log: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", by_bucket: int | None = None) -> None:
    """Write a log so that reads of one stream and of a time range skip most files.

    ``by_bucket`` partitions by a hash of the stream id; ``stream_bucket`` gives the
    predicate for a reader.  Inside, rows are sorted by stream and version.
    """
    if by_bucket:
        log = log.withColumn("bucket", F.pmod(F.xxhash64("stream_id"), F.lit(by_bucket)).cast("int"))
        # A hot stream's bucket is written by several tasks, each with its own version range.
        log = log.repartition("bucket", F.expr("version div 1000000")).sortWithinPartitions("bucket", "stream_id", "version")
        log.write.format(fmt).mode(mode).partitionBy("bucket").save(path)
    else:
        log.sortWithinPartitions("stream_id", "version").write.format(fmt).mode(mode).save(path)


def stream_bucket(spark: SparkSession, stream_id: str, buckets: int) -> int:
    """The bucket that holds a stream, as a literal, so that partition pruning can use it."""
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(stream_id)), F.lit(buckets))).first()[0]


def from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders and their lines as a log: version 0 is the order, then its lines; amounts are tagged sums."""
    head = orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("stream_id"), F.lit(0).cast("long").alias("version"), F.lit("OrderPlaced").alias("event_type"),
        F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("data"), F.array(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string"))).alias("tags"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("epoch_us"),
    )
    amount = F.struct(F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("sum"))
    quantity = F.struct(F.col("l_quantity").cast("decimal(18,2)").alias("sum"))
    line = lineitem.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("stream_id"), F.col("l_linenumber").cast("long").alias("version"), F.lit("LineAdded").alias("event_type"),
        F.to_json(F.struct(amount.alias("amount"), quantity.alias("quantity"), F.struct(F.col("l_linestatus").alias("overwrite")).alias("status"))).alias("data"),
        F.array(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")), F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string"))).alias("tags"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("epoch_us"),
    )
    both = head.unionByName(line)
    return both.select(
        "stream_id", "version", F.concat("stream_id", F.lit("/"), F.col("version").cast("string")).alias("event_id"), "event_type", "data", F.create_map().cast("map<string,string>").alias("metadata"), "tags",
        F.expr("epoch_us div 1000").alias("timestamp_ms"), "epoch_us", F.when(F.col("version") > 0, F.concat("stream_id", F.lit("/"), (F.col("version") - 1).cast("string"))).alias("causation_id"), F.col("stream_id").alias("correlation_id"),
    )


def order_ops(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """What the events of :func:`from_orders` do to the fields of a stream, from the typed columns.

    The rows are those of ``fold.fold_ops`` over that log, without JSON text in between.
    """
    number = "decimal(38,6)"

    def op(field, delta=None, text=None):
        none = F.lit(None)
        return F.struct(F.lit(field).alias("field"), (none if delta is None else delta).cast(number).alias("delta"), (none if text is None else text).cast("string").alias("set_to"), none.cast(number).alias("set_number"))

    quoted = lambda c: F.to_json(F.col(c).cast("variant"))
    head = orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("group"), F.lit(0).cast("long").alias("position"), F.inline(F.when(F.col("o_orderstatus").isNotNull(), F.array(op("status", text=quoted("o_orderstatus")))))
    )
    amount, quantity = F.round("l_extendedprice", 2).cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    fields_of_line = F.array(
        *[F.when(x.isNotNull(), op(n, x)).otherwise(op(n, text=F.lit("{}"))) for n, x in (("amount", amount), ("quantity", quantity))],
        F.when(F.col("l_linestatus").isNotNull(), op("status", text=quoted("l_linestatus"))).otherwise(op("status", text=F.lit("{}"))),
    )
    line = lineitem.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("group"), F.col("l_linenumber").cast("long").alias("position"), F.inline(fields_of_line))
    return head.unionByName(line)
