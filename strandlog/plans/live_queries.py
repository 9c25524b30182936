"""Streaming operators run to the end of what lies in a folder, so that SQL can be held against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import links
from strandlog.plans.event_store import EV, KEY, fold_sql
from strandlog.runtime import Scratch
from strandlog.sources.log import event_log, write_log
from strandlog.streaming import live

#: The log comes in by version: earlier versions of a stream arrive before later ones.
ARRIVALS = ((0, 4), (5, 49), (50, 2**62))


def _run(spark: SparkSession, folder: str, label: str, start) -> Scratch:
    """Let the canonical log arrive in several parts, and run the query ``start`` gives after each: it goes on where it was.

    A part is written by as many tasks as the log has, so a hot stream is no file of its own.
    """
    scratch = Scratch(spark, label)
    log = scratch.write(event_log(spark, folder), "log")
    for low, high in ARRIVALS:
        write_log(log.where(F.col("version").between(low, high)), scratch.path("in"))
        _finish(start(scratch, live.log_stream(spark, scratch.path("in"))))
    return scratch


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def live_subscription(spark: SparkSession, folder: str) -> DataFrame:
    def start(scratch: Scratch, stream: DataFrame):
        def keep(batch: DataFrame, number: int) -> None:
            batch.select(*KEY).write.mode("overwrite").parquet(f"{scratch.path('out')}/batch={number}")

        return live.deliver(stream, "event_payload", {"qty": {"gt": 30}}, keep, "live_subscription", scratch.path("checkpoint"), start_from=2, available_now=True)

    return spark.read.parquet(_run(spark, folder, "live-subscription", start).path("out")).select(*KEY)


def live_link(spark: SparkSession, folder: str) -> DataFrame:
    link = links.Link("priced", links.Source("all"), lambda df: F.col("event_type") == "OrderPriced")
    scratch = _run(spark, folder, "live-link", lambda s, stream: live.run_link(stream, link, s.path("out"), s.path("checkpoint"), available_now=True))
    m = F.col("metadata")
    return spark.read.parquet(scratch.path("out")).select("stream_id", "version", "event_id", m["source_stream"].alias("source_stream"), m["source_version"].alias("source_version"))


def _update(query: DataFrame, scratch: Scratch):
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{scratch.path('out')}/{number:06d}")

    return query.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start()


def live_totals(spark: SparkSession, folder: str) -> DataFrame:
    scratch = _run(spark, folder, "live-totals", lambda s, stream: _update(live.running_totals(stream, "amount"), s))
    parts = spark.read.option("recursiveFileLookup", "true").parquet(scratch.path("out"))
    last = parts.groupBy("stream_id").agg(F.max("events").alias("events"), F.max("last_version").alias("last_version"), F.max_by("total", "events").alias("total"))
    return last.select("stream_id", "events", "last_version", F.col("total").cast("double").alias("total"))


def live_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The stateful fold, batch by batch in version order: the last state of every key that is numeric."""
    scratch = _run(spark, folder, "live-fold", lambda s, stream: _update(live.running_fold(stream), s))
    parts = spark.read.option("recursiveFileLookup", "true").parquet(scratch.path("out"))
    last = parts.groupBy("group", "field").agg(F.max_by(F.struct("number", "value"), "batch").alias("s"))
    return last.select(F.col("group").alias("stream_id"), "field", F.col("s.number").cast("double").alias("number"))


QUERIES = {"live_subscription": live_subscription, "live_link": live_link, "live_totals": live_totals, "live_fold": live_fold}

ORACLES = {
    "live_subscription": EV + "SELECT stream_id, version, event_id FROM ev WHERE version >= 2 AND CASE WHEN json_type(js) = 'OBJECT' AND json_type(js, '$.qty') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(js ->> '$.qty' AS DOUBLE) > 30 END",
    "live_link": EV + "SELECT '$link:priced' AS stream_id, row_number() OVER (ORDER BY CASE WHEN version <= 4 THEN 0 WHEN version <= 49 THEN 1 ELSE 2 END, stream_id, version, event_id) - 1 AS version, event_id, stream_id AS source_stream, CAST(version AS VARCHAR) AS source_version FROM ev WHERE event_type = 'OrderPriced'",
    "live_totals": EV + """, v AS (SELECT stream_id, version, CASE WHEN json_type(js) = 'OBJECT' THEN js -> '$.amount' END AS a FROM ev)
SELECT stream_id, count(*) AS events, max(version) AS last_version, CAST(sum(CASE WHEN json_type(a) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(CAST(a AS VARCHAR) AS DECIMAL(38,6)) WHEN json_type(a) = 'OBJECT' AND json_type(a, '$.sum') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(a ->> '$.sum' AS DECIMAL(38,6)) END) AS DOUBLE) AS total FROM v GROUP BY stream_id""",
    "live_fold": f"SELECT stream_id, field, number FROM ({fold_sql('p')})",
}
