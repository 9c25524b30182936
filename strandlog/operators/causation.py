"""What caused an event and what it caused, by the causation and correlation ids events carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.operators import graph
from strandlog.operators.streams import GLOBAL_ORDER
from strandlog.runtime import heavy_keys, join_to_unique

HEAVY_SHARE, SALTS = 0.005, 32
NO_CAUSE, NOT_FOUND, FOUND = "no_cause", "not_found", "found"


def with_causes(log: DataFrame) -> DataFrame:
    """The log with causation and correlation ids as columns, lifted from the metadata where they are not there."""
    have = set(log.columns)
    out = log
    for c in ("causation_id", "correlation_id"):
        lifted = F.col("metadata")[c]
        out = out.withColumn(c, F.coalesce(F.col(c), lifted) if c in have else lifted)
    return out


def scan_for_metadata(log: DataFrame, key: str, value: str) -> DataFrame:
    """All events whose metadata has the value under the key, by time."""
    return log.where(F.col("metadata")[key] == value).orderBy(*GLOBAL_ORDER)


def find_event_by_id(log: DataFrame, event_id: str) -> DataFrame:
    """The event with this id, or no row; of several the first by stream and version."""
    return log.where(F.col("event_id") == event_id).orderBy("stream_id", "version").limit(1)


def get_effects(log: DataFrame, event_id: str) -> DataFrame:
    """Direct effects of an event by time."""
    return log.where(F.col("causation_id") == event_id).orderBy(*GLOBAL_ORDER)


def get_correlated(log: DataFrame, correlation_id: str) -> DataFrame:
    """All events of a correlation by time."""
    return log.where(F.col("correlation_id") == correlation_id).orderBy(*GLOBAL_ORDER)


def effect_counts(log: DataFrame) -> DataFrame:
    """``event_id, effects, first_effect_us`` of every event that caused something, in one pass."""
    return log.where("causation_id is not null and causation_id <> ''").groupBy(F.col("causation_id").alias("event_id")).agg(F.count(F.lit(1)).alias("effects"), F.min("epoch_us").alias("first_effect_us"))


def causes(log: DataFrame) -> DataFrame:
    """``event_id, status, cause_id, cause_stream, cause_version, cause_type`` for every event at once.

    Status is no_cause without a (non-empty) causation id, not_found where no event has it,
    else found.  Effects of a cause that has very many are spread over tasks.
    """
    child = log.select("event_id", F.when(F.col("causation_id") != "", F.col("causation_id")).alias("wanted"))
    parent = log.select(F.col("event_id").alias("cause_id"), F.col("stream_id").alias("cause_stream"), F.col("version").alias("cause_version"), F.col("event_type").alias("cause_type"))
    _, heavy = heavy_keys(child, ["wanted"], HEAVY_SHARE)
    joined = join_to_unique(child, parent, "wanted", "cause_id", "left", heavy, SALTS, ["event_id"])
    status = F.when(F.col("wanted").isNull(), NO_CAUSE).when(F.col("cause_id").isNull(), NOT_FOUND).otherwise(FOUND)
    return joined.select("event_id", status.alias("status"), "cause_id", "cause_stream", "cause_version", "cause_type")


def get_cause(log: DataFrame, event_id: str) -> tuple[str, DataFrame | None]:
    """(status, cause) of one event."""
    found = find_event_by_id(log, event_id).select("causation_id").collect()
    if not found:
        return NOT_FOUND, None
    if not found[0].causation_id:
        return NO_CAUSE, None
    cause = find_event_by_id(log, found[0].causation_id)
    return (NOT_FOUND, None) if cause.isEmpty() else (FOUND, cause)


def _links(log: DataFrame) -> DataFrame:
    return log.select(F.col("event_id").alias("id"), F.when(F.col("causation_id") != "", F.col("causation_id")).alias("cause"))


def get_chain(log: DataFrame, event_id: str) -> DataFrame:
    """The events from the root cause down to the event, with ``depth`` from the root.

    The chain ends where a cause is missing; in a circle it ends before an event comes again.
    An unknown event has none.
    """
    start = log.where(F.col("event_id") == event_id).select(F.col("event_id").alias("start")).distinct()
    up = graph.reach(graph.build_edges(_links(log)), start, backward=True)
    far = up.agg(F.max("distance")).first()[0] or 0
    rows = log.join(up.select("node", "distance"), F.col("event_id") == F.col("node"))
    return rows.withColumn("depth", F.lit(far) - F.col("distance")).drop("node", "distance").orderBy("depth")


def build_graph(log: DataFrame, wanted: str) -> tuple[DataFrame, DataFrame, str | None] | None:
    """``(nodes, edges, root)`` for an event id or, failing that, a correlation id; None if it is neither.

    From an event: its root cause and everything that root led to.  From a correlation: its
    events and the links inside it; the root is the earliest event that none of them caused.
    """
    hit = log.where(F.col("event_id") == wanted).select("event_id").take(1)
    links = _links(log)
    if hit:
        spark = log.sparkSession
        edges = graph.build_edges(links).distinct()
        up = graph.reach(edges, spark.createDataFrame([(wanted,)], "start string"), backward=True)
        root = up.orderBy(F.col("distance").desc(), "node").first().node
        down = graph.reach(edges, spark.createDataFrame([(root,)], "start string"))
        nodes = log.join(down.select("node"), F.col("event_id") == F.col("node"), "left_semi")
    else:
        nodes = log.where(F.col("correlation_id") == wanted)
        if nodes.isEmpty():
            return None
        edges, root = None, None
    inside = graph.build_edges(_links(nodes)).distinct()
    if not hit:
        first = graph.find_roots(nodes.withColumn("node", F.col("event_id")), inside).orderBy(*GLOBAL_ORDER).first()
        root = first.event_id if first else None
    return nodes, inside, root


def correlation_graphs(log: DataFrame) -> DataFrame:
    """``correlation_id, events, links, roots, root`` of every correlation at once.

    ``links`` are causes inside the correlation; ``root`` is the earliest event not caused inside it.
    """
    inner = log.where("correlation_id is not null").select("correlation_id", "event_id", F.when(F.col("causation_id") != "", F.col("causation_id")).alias("cause"), "epoch_us", "stream_id", "version")
    known = inner.select(F.col("correlation_id").alias("k_corr"), F.col("event_id").alias("k_id"))
    marked = inner.join(known, (F.col("correlation_id") == F.col("k_corr")) & (F.col("cause") == F.col("k_id")), "left")
    free = F.col("k_id").isNull()
    return marked.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~free).alias("links"),
        F.count_if(free).alias("roots"),
        F.min_by(F.col("event_id"), F.when(free, F.struct("epoch_us", "stream_id", "version"))).alias("root"),
    )


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """The small form of a causation graph: ids as they are, label of id and type; an empty graph has no lines."""
    esc = graph.escape_dot
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("event_id"), F.lit(' [label="'), esc(F.col("event_id")), F.lit("\\n"), esc(F.coalesce("event_type", F.lit(""))), F.lit('"];')).alias("line"))
    e = edges.select(F.lit(2), F.concat(F.lit("  "), F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(";")))
    lines = [r.line for r in n.union(e).orderBy("part", "line").toLocalIterator()]
    return "\n".join(["digraph causation {", *lines, "}"]) + "\n"
