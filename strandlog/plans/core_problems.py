"""Queries of the general data problems over event_log, with the SQL they are checked against."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import dedup, features, hierarchy, increments, patterns, skew
from strandlog.runtime import Scratch
from strandlog.sources.tables import table

HOT_STREAM_SHARE = Fraction(2, 100)
LEDGER_RUNS = 3


def _amount():
    """The amount of an event: a plain number or the number of a tagged sum; anything else is none."""
    raw = F.get_json_object("data", "$.amount")
    text = F.when(F.substring(raw, 1, 1) == "{", F.get_json_object(raw, "$.sum")).otherwise(raw)
    return F.expr("1") * F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text).try_cast("decimal(28,6)")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.keys_with_share(table(spark, folder, "event_log"), "stream_id", HOT_STREAM_SHARE, spread=["delivery_id"]).select("stream_id")


def p1_stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    m = skew.Measure
    measures = [
        m("n_rows", "count"), m("n_events", "count_distinct", "event_id"), m("first_version", "min", "version"), m("last_version", "max", "version"),
        m("first_epoch_us", "min", "epoch_us"), m("last_epoch_us", "max", "epoch_us"), m("n_tagged", "count", "tags"),
    ]
    return skew.salted_aggregate(table(spark, folder, "event_log"), ["stream_id"], measures).frame


P1_TOTALS_SQL = """
SELECT stream_id, count(*) AS n_rows, count(DISTINCT event_id) AS n_events, min(version) AS first_version, max(version) AS last_version,
       min(epoch_us) AS first_epoch_us, max(epoch_us) AS last_epoch_us, count(tags) AS n_tagged
FROM event_log GROUP BY stream_id"""


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, folder, "event_log"), "event_id", "causation_id", only_children=True)
    return h.where("parent is not null").select(F.col("node").alias("event_id"), F.col("root").alias("root_event_id"), "depth")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and path of every event; below and in circles the path starts at the far end of the circle, each event once."""
    h = hierarchy.hierarchy(table(spark, folder, "event_log"), "event_id", "causation_id", with_paths=True, with_walks=True)
    path = F.coalesce("path", F.reverse("walk"))
    return h.select(F.col("node").alias("event_id"), F.col("root").alias("root_event_id"), "depth", F.array_join(path, ">").alias("path"))


def p2_effects(spark: SparkSession, folder: str) -> DataFrame:
    """All effects of every event, also of those in and below circles (pairs of different events, fewest steps)."""
    h = hierarchy.hierarchy(table(spark, folder, "event_log"), "event_id", "causation_id", with_paths=True, only_children=True, with_walks=True)
    e = hierarchy.effects(h)
    return e.select(F.col("ancestor").alias("event_id"), F.col("node").alias("effect_id"), "distance")


_TREE = """
WITH RECURSIVE ev AS (SELECT DISTINCT event_id, CASE WHEN causation_id <> '' THEN causation_id END AS cause FROM event_log),
link AS (SELECT c.event_id, c.cause, p.event_id AS parent FROM ev c LEFT JOIN ev p ON c.cause = p.event_id),
tree AS (
  SELECT event_id, event_id AS root_event_id, 0 AS depth, event_id AS path FROM link WHERE parent IS NULL
  UNION ALL
  SELECT l.event_id, t.root_event_id, t.depth + 1, t.path || '>' || l.event_id FROM tree t JOIN link l ON l.parent = t.event_id
),
loose AS (SELECT l.event_id, l.parent FROM link l WHERE l.event_id NOT IN (SELECT event_id FROM tree)),
reach AS (
  SELECT event_id, parent AS node FROM loose
  UNION
  SELECT r.event_id, l.parent FROM reach r JOIN loose l ON l.event_id = r.node
),
circle AS (SELECT event_id AS node FROM reach WHERE event_id = node),
bad AS (SELECT r.event_id, min(r.node) AS root_event_id FROM reach r JOIN circle c ON c.node = r.node GROUP BY r.event_id)
"""

P2_FOUND_SQL = _TREE + """
SELECT event_id, root_event_id, CAST(depth AS BIGINT) AS depth FROM (
  SELECT event_id, root_event_id, depth FROM tree UNION ALL SELECT event_id, root_event_id, -1 FROM bad)
WHERE event_id IN (SELECT event_id FROM ev WHERE cause IS NOT NULL)"""

#: Every event's walk up its causes to the root or to the first event met again; no tree is asked for.
_WALK = """
, walk AS (
  SELECT event_id, event_id AS node, 0 AS distance, [event_id] AS seen FROM link
  UNION ALL
  SELECT w.event_id, l.parent, w.distance + 1, list_append(w.seen, l.parent) FROM walk w JOIN link l ON l.event_id = w.node
  WHERE l.parent IS NOT NULL AND NOT list_contains(w.seen, l.parent)
)
"""

P2_PATHS_SQL = _TREE + _WALK + """
SELECT event_id, root_event_id, CAST(depth AS BIGINT) AS depth, path FROM tree
UNION ALL
SELECT b.event_id, b.root_event_id, -1, (SELECT array_to_string(list_reverse(arg_max(w.seen, w.distance)), '>') FROM walk w WHERE w.event_id = b.event_id) FROM bad b"""

P2_EFFECTS_SQL = _TREE + _WALK + """
SELECT node AS event_id, event_id AS effect_id, CAST(distance AS BIGINT) AS distance FROM walk WHERE distance > 0"""


def _features(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    return features.entity_features(table(spark, folder, "event_log"), "stream_id", "event_type", "epoch_us", "event_id", "delivery_id", _amount(), layout)


def p3_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "wide")


def p3_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The filled cells of the feature rows, one row each: the form SQL can be held against."""
    f = _features(spark, folder, "map")
    cells = f.select("stream_id", F.explode("features").alias("event_type", "x"))
    return cells.select("stream_id", "event_type", F.col("x.n").alias("n"), F.col("x.last_time").alias("last_epoch_us"), F.col("x.total").cast("double").alias("total"))


P3_CELLS_SQL = r"""
WITH one AS (
  SELECT stream_id, event_type, event_id, epoch_us, data FROM event_log
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY epoch_us, delivery_id) = 1),
raw AS (SELECT *, CASE WHEN json_valid(data) THEN CASE WHEN json_type(data, '$.amount') = 'OBJECT' THEN data ->> '$.amount.sum' ELSE data ->> '$.amount' END END AS a FROM one)
SELECT stream_id, event_type, count(*) AS n, max(epoch_us) AS last_epoch_us,
       CAST(sum(CASE WHEN regexp_full_match(a, '-?[0-9]+(\.[0-9]+)?') THEN CAST(a AS DECIMAL(28,6)) END) AS DOUBLE) AS total
FROM raw WHERE event_type IS NOT NULL GROUP BY ALL"""

_AMOUNTS = r"""(SELECT stream_id, event_type, epoch_us, CASE WHEN regexp_full_match(a, '-?[0-9]+(\.[0-9]+)?') THEN CAST(a AS DECIMAL(28,6)) END AS amount FROM (
  SELECT stream_id, event_type, epoch_us, CASE WHEN json_valid(data) THEN CASE WHEN json_type(data, '$.amount') = 'OBJECT' THEN data ->> '$.amount.sum' ELSE data ->> '$.amount' END END AS a FROM (
    SELECT stream_id, event_type, event_id, epoch_us, data FROM event_log QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY epoch_us, delivery_id) = 1)))"""

#: The types become columns as the data has them; the source is spelled out twice because such a pivot sees no WITH.
P3_FEATURES_SQL = rf"""
SELECT e.*, COALESCE(COLUMNS('^(.*)_n$'), 0) AS 'n:\1', COLUMNS('^(.*)_last$') AS 'last:\1', COLUMNS('^(.*)_total$') AS 'total:\1' FROM 
(SELECT stream_id, count(*) AS n_events, max(epoch_us) AS last_time, sum(amount) AS total, count(*) FILTER (event_type IS NULL) AS n_untyped FROM {_AMOUNTS} GROUP BY stream_id) e
LEFT JOIN (PIVOT (SELECT * FROM {_AMOUNTS} WHERE event_type IS NOT NULL) ON event_type USING count(epoch_us) AS n, max(epoch_us) AS last, sum(amount) AS total GROUP BY stream_id) w ON w.stream_id IS NOT DISTINCT FROM e.stream_id"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    f = patterns.frequent_patterns(table(spark, folder, "event_log"), "stream_id", "version", "event_type", "event_id", Fraction(1, 10), 3, 5)
    return f.select(F.array_join("items", ">").alias("pattern"), "support")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    index = Scratch(spark, "deliveries").path("index")
    lost = dedup.duplicate_rows(table(spark, folder, "event_log"), "event_id", "epoch_us", "delivery_id", "batch_id", index)
    return lost.select(F.col("row").alias("delivery_id"))


P5_FOUND_SQL = """
SELECT delivery_id FROM event_log
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY epoch_us, delivery_id) > 1"""


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "run_offsets").where("state = 'committed'")
    return c.select(F.col("stream_id").alias("stream"), F.col("from_version").alias("first"), F.col("to_version").alias("last"), F.col("read_to_batch").alias("seen"))


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "event_log")
    return e.select(F.col("stream_id").alias("stream"), F.col("version").alias("number"), F.col("batch_id").alias("arrived"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    p = increments.pending(_arrivals(spark, folder), _claims(spark, folder))
    return p.select(F.col("stream").alias("stream_id"), F.col("number").alias("version"))


P6_FOUND_SQL = """
WITH e AS (SELECT stream_id, version, min(batch_id) AS arrived FROM event_log GROUP BY stream_id, version)
SELECT stream_id, version FROM e WHERE NOT EXISTS (
  SELECT 1 FROM run_offsets r WHERE r.stream_id = e.stream_id AND r.state = 'committed'
  AND r.from_version <= e.version AND e.version <= r.to_version AND r.read_to_batch >= e.arrived)"""


def p6_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The run that takes each event, when the whole log goes through a new ledger in runs of neighbouring batches."""
    e = _arrivals(spark, folder)
    span = e.agg(F.min("arrived").alias("a"), F.max("arrived").alias("z")).first()
    low = span.a or 0
    width = ((span.z or 0) - low) // LEDGER_RUNS + 1
    ledger = increments.IntervalLedger(spark, Scratch(spark, "ledger").path("runs"))
    for k in range(LEDGER_RUNS):
        ledger.run(e, lambda rows, k=k: rows.select("stream", "number", F.lit(k).cast("long").alias("run")).distinct(), low + (k + 1) * width - 1)
    return ledger.output().select(F.col("stream").alias("stream_id"), F.col("number").alias("version"), "run")


P6_LEDGER_SQL = f"""
WITH e AS (SELECT stream_id, version, min(coalesce(batch_id, (SELECT min(batch_id) FROM event_log))) AS arrived
  FROM event_log WHERE stream_id IS NOT NULL AND version IS NOT NULL GROUP BY stream_id, version),
b AS (SELECT min(batch_id) AS low, (max(batch_id) - min(batch_id)) // {LEDGER_RUNS} + 1 AS width FROM event_log)
SELECT stream_id, version, CAST((arrived - low) // width AS BIGINT) AS run FROM e, b"""


def p6_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """What the committed runs cover of the versions that exist, as disjoint intervals."""
    e = _arrivals(spark, folder)
    bounds = e.groupBy("stream").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    d = increments.disjoint_intervals(_claims(spark, folder), bounds)
    return d.select(F.col("stream").alias("stream_id"), F.col("first").alias("from_version"), F.col("last").alias("to_version"), F.col("seen").alias("read_to_batch"))


P6_INTERVALS_SQL = """
WITH b AS (SELECT stream_id, min(version) AS low, max(version) AS high FROM event_log GROUP BY stream_id),
n AS (SELECT stream_id, unnest(range(low, high + 1)) AS v FROM b),
c AS (SELECT n.stream_id, v, max(read_to_batch) AS seen FROM n JOIN run_offsets r ON r.stream_id = n.stream_id AND r.state = 'committed' AND v BETWEEN from_version AND to_version GROUP BY ALL),
g AS (SELECT *, v - row_number() OVER (PARTITION BY stream_id, seen ORDER BY v) AS grp FROM c)
SELECT stream_id, min(v) AS from_version, max(v) AS to_version, seen AS read_to_batch FROM g GROUP BY stream_id, seen, grp"""

P1_FOUND_SQL = """
SELECT stream_id FROM event_log GROUP BY stream_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM event_log)"""

#: Patterns of three to five of the few frequent types, grown in SQL over the earliest version of each step.
P4_FOUND_SQL = """
WITH n AS (SELECT ceil(count(DISTINCT stream_id) / 10.0) AS need FROM event_log),
ev AS (SELECT DISTINCT stream_id, version, event_id, event_type FROM event_log WHERE event_type IS NOT NULL),
f AS (SELECT event_type FROM ev GROUP BY event_type HAVING count(DISTINCT stream_id) >= (SELECT need FROM n)),
s AS (SELECT ev.* FROM ev JOIN f USING (event_type)),
l1 AS (SELECT stream_id, event_type AS pattern, min(version) AS v FROM s GROUP BY ALL),
l2 AS (SELECT a.stream_id, a.pattern || '>' || s.event_type AS pattern, min(s.version) AS v FROM l1 a JOIN s ON s.stream_id = a.stream_id AND s.version > a.v GROUP BY ALL),
k2 AS (SELECT l2.* FROM l2 JOIN (SELECT pattern FROM l2 GROUP BY 1 HAVING count(*) >= (SELECT need FROM n)) USING (pattern)),
l3 AS (SELECT a.stream_id, a.pattern || '>' || s.event_type AS pattern, min(s.version) AS v FROM k2 a JOIN s ON s.stream_id = a.stream_id AND s.version > a.v GROUP BY ALL),
k3 AS (SELECT l3.* FROM l3 JOIN (SELECT pattern FROM l3 GROUP BY 1 HAVING count(*) >= (SELECT need FROM n)) USING (pattern)),
l4 AS (SELECT a.stream_id, a.pattern || '>' || s.event_type AS pattern, min(s.version) AS v FROM k3 a JOIN s ON s.stream_id = a.stream_id AND s.version > a.v GROUP BY ALL),
k4 AS (SELECT l4.* FROM l4 JOIN (SELECT pattern FROM l4 GROUP BY 1 HAVING count(*) >= (SELECT need FROM n)) USING (pattern)),
l5 AS (SELECT a.stream_id, a.pattern || '>' || s.event_type AS pattern, min(s.version) AS v FROM k4 a JOIN s ON s.stream_id = a.stream_id AND s.version > a.v GROUP BY ALL),
k5 AS (SELECT l5.* FROM l5 JOIN (SELECT pattern FROM l5 GROUP BY 1 HAVING count(*) >= (SELECT need FROM n)) USING (pattern))
SELECT pattern, count(*) AS support FROM (SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5) GROUP BY pattern"""

QUERIES = {
    "p1_found": p1_found, "p1_stream_totals": p1_stream_totals, "p2_found": p2_found, "p2_paths": p2_paths, "p2_effects": p2_effects,
    "p3_features": p3_features, "p3_cells": p3_cells, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_ledger": p6_ledger, "p6_intervals": p6_intervals,
}

ORACLES = {
    "p1_found": P1_FOUND_SQL, "p1_stream_totals": P1_TOTALS_SQL, "p2_found": P2_FOUND_SQL, "p2_paths": P2_PATHS_SQL, "p2_effects": P2_EFFECTS_SQL,
    "p3_features": P3_FEATURES_SQL, "p3_cells": P3_CELLS_SQL, "p4_found": P4_FOUND_SQL, "p5_found": P5_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p6_ledger": P6_LEDGER_SQL, "p6_intervals": P6_INTERVALS_SQL,
}
