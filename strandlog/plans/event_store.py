"""Queries of the event store's operators over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import codec, hashing, text
from strandlog.operators import causation, flow, fold, graph, links, operations, retention, schema_registry, security, snapshots, streams, subscriptions, temporal
from strandlog.operators.archive import key_column, parsed_key
from strandlog.runtime import Scratch
from strandlog.sources.log import event_log, from_orders, from_user_events, read_log, write_log, order_ops
from strandlog.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A stream, a time and some types that occur at every size of the test tables.
STREAM = "hub-intake"
AT, UNTIL = 1547100000000000, 1547500000000000
TYPES = ["OrderPriced", "NoticeSent", "KeyRotated"]
KEY = ["stream_id", "version", "event_id"]

EV = """WITH ev AS (SELECT *, CASE WHEN json_valid(data) THEN data END AS js FROM event_log QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY epoch_us, delivery_id) = 1)
"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _ev(spark, folder, *columns):
    return event_log(spark, folder, list(dict.fromkeys([*KEY, *columns])))


# Streams

@query(EV + f"SELECT stream_id, version, event_id, event_type FROM ev WHERE stream_id = '{STREAM}' AND version BETWEEN 10 AND 59")
def stream_read_forward(spark, folder):
    return streams.read(_ev(spark, folder, "event_type"), STREAM, 10, 50).select(*KEY, "event_type")


@query(EV + f"SELECT stream_id, version, event_id, event_type FROM ev WHERE stream_id = '{STREAM}' AND version BETWEEN 0 AND 30")
def stream_read_backward(spark, folder):
    return streams.read(_ev(spark, folder, "event_type"), STREAM, 30, 50, "backward").select(*KEY, "event_type")


@query(EV + f"SELECT stream_id, version, event_id FROM ev WHERE stream_id = '{STREAM}' ORDER BY version DESC LIMIT 25")
def stream_read_all_backward(spark, folder):
    return streams.read_all(_ev(spark, folder), STREAM, 25, "backward").select(*KEY)


@query(EV + "SELECT stream_id, version, event_id, epoch_us FROM ev")
def scan_all_streams(spark, folder):
    return streams.scan_all(_ev(spark, folder, "epoch_us")).select(*KEY, "epoch_us")


@query(EV + f"SELECT stream_id, version, event_id, event_type FROM ev WHERE event_type IN {tuple(TYPES)}")
def read_by_event_types(spark, folder):
    return streams.read_by_event_types(_ev(spark, folder, "event_type", "epoch_us"), TYPES).select(*KEY, "event_type")


@query(EV + f"SELECT stream_id, version, event_id FROM ev WHERE event_type IN {tuple(TYPES)} ORDER BY epoch_us, stream_id, version LIMIT 100")
def read_by_event_types_first(spark, folder):
    return streams.read_by_event_types(_ev(spark, folder, "event_type", "epoch_us"), TYPES, 100).select(*KEY)


@query(EV + "SELECT stream_id, version, event_id FROM ev ORDER BY epoch_us, stream_id, version LIMIT 200")
def read_by_no_event_types(spark, folder):
    return streams.read_by_event_types(_ev(spark, folder, "event_type", "epoch_us"), [], 200).select(*KEY)


@query(EV + "SELECT stream_id, version, event_id, array_to_string(tags, ',') AS tags FROM ev WHERE list_has_any(tags, ['zone:3', 'zone:5'])")
def read_by_tags_any(spark, folder):
    return streams.read_by_tags(_ev(spark, folder, "tags", "epoch_us"), ["zone:3", "zone:5"]).select(*KEY, F.array_join("tags", ",").alias("tags"))


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE list_has_all(tags, ['zone:4', 'lot:40'])")
def read_by_tags_all(spark, folder):
    return streams.read_by_tags(_ev(spark, folder, "tags", "epoch_us"), ["zone:4", "lot:40"], "all").select(*KEY)


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE false")
def read_by_no_tags(spark, folder):
    return streams.read_by_tags(_ev(spark, folder, "tags", "epoch_us"), []).select(*KEY)


@query(EV + "SELECT DISTINCT tag, stream_id, version FROM (SELECT unnest(tags) AS tag, stream_id, version FROM ev) WHERE tag IS NOT NULL")
def tag_index(spark, folder):
    return streams.tag_index(_ev(spark, folder, "tags"))


@query(EV + "SELECT stream_id, max(version) AS version, count(*) AS events FROM ev GROUP BY stream_id")
def stream_versions(spark, folder):
    return streams.versions(_ev(spark, folder))


@query("SELECT DISTINCT stream_id FROM event_log")
def list_streams(spark, folder):
    return streams.list_streams(table(spark, folder, "event_log"))


@query("SELECT id, selector AS stream_id, selector IN (SELECT stream_id FROM event_log) AS found FROM subscriptions")
def stream_exists(spark, folder):
    wanted = table(spark, folder, "subscriptions").select("id", F.col("selector").alias("stream_id"))
    return streams.existing(table(spark, folder, "event_log"), wanted)


@query("""WITH cur AS (SELECT stream_id AS s, max(version) AS current FROM event_log GROUP BY 1), req AS (SELECT run_id, stream_id, from_version, CASE WHEN run_id % 5 = 0 THEN -2 WHEN run_id % 5 = 1 THEN -1 ELSE to_version END AS expected FROM run_offsets)
SELECT run_id, stream_id, from_version, expected, coalesce(current, -1) AS current, expected = -2 OR expected = coalesce(current, -1) AS accepted FROM req LEFT JOIN cur ON s = stream_id""")
def append_expectations(spark, folder):
    r = F.col("run_id") % 5
    req = table(spark, folder, "run_offsets").select("run_id", "stream_id", "from_version", F.when(r == 0, -2).when(r == 1, -1).otherwise(F.col("to_version")).alias("expected"))
    cur = streams.versions(table(spark, folder, "event_log")).select(F.col("stream_id").alias("s"), F.col("version").alias("current"))
    both = req.join(cur, F.col("stream_id") == F.col("s"), "left").withColumn("current", F.coalesce("current", F.lit(-1)))
    return both.select("run_id", "stream_id", "from_version", "expected", "current", streams.version_accepted(F.col("expected"), F.col("current")).alias("accepted"))


@query("""WITH cur AS (SELECT stream_id AS s, max(version) AS current FROM event_log GROUP BY 1), req AS (SELECT run_id, stream_id, from_version, CASE run_id % 5 WHEN 0 THEN 'any' WHEN 1 THEN 'stream_exists' WHEN 2 THEN '0' ELSE CAST(to_version AS VARCHAR) END AS expected FROM run_offsets)
SELECT run_id, stream_id, from_version, expected, coalesce(current, -1) AS current,
 CASE expected WHEN 'any' THEN true WHEN 'stream_exists' THEN coalesce(current, -1) >= 0 ELSE (CAST(expected AS BIGINT) = 0 AND coalesce(current, -1) = -1) OR CAST(expected AS BIGINT) = coalesce(current, -1) END AS accepted FROM req LEFT JOIN cur ON s = stream_id""")
def gateway_expectations(spark, folder):
    r = F.col("run_id") % 5
    req = table(spark, folder, "run_offsets").select("run_id", "stream_id", "from_version", F.when(r == 0, "any").when(r == 1, "stream_exists").when(r == 2, "0").otherwise(F.col("to_version").cast("string")).alias("expected"))
    cur = streams.versions(table(spark, folder, "event_log")).select(F.col("stream_id").alias("s"), F.col("version").alias("current"))
    both = req.join(cur, F.col("stream_id") == F.col("s"), "left").withColumn("current", F.coalesce("current", F.lit(-1)))
    return both.select("run_id", "stream_id", "from_version", "expected", "current", streams.version_accepted(F.col("expected"), F.col("current"), "gateway").alias("accepted"))


@query(EV + "SELECT event_id, lpad(CAST(version AS VARCHAR), 12, '0') AS padded FROM ev")
def padded_versions(spark, folder):
    return _ev(spark, folder).select("event_id", streams.padded(F.col("version")).alias("padded"))


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.stream_id = ev.stream_id AND ev.version <= s.version)")
def log_after_deletes(spark, folder):
    """Streams deleted at their last snapshot: what was appended since."""
    return streams.without_deleted(_ev(spark, folder), table(spark, folder, "snapshots").select("stream_id", "version")).select(*KEY)


@query("""SELECT 'user-' || user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS version, CAST(event_id AS VARCHAR) AS event_id, event_type, epoch_us(ts) AS epoch_us,
 CAST(event_id % 3 + 1 AS VARCHAR) AS schema_version, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id - event_id % 7 - 1 AS VARCHAR) END AS causation_id, CAST(event_id // 20 AS VARCHAR) AS correlation_id, 'user:' || user_id || ',type:' || event_type AS tags FROM events""")
def user_log(spark, folder):
    log = from_user_events(table(spark, folder, "events"))
    return log.select("stream_id", "version", "event_id", "event_type", "epoch_us", F.col("metadata")["schema_version"].alias("schema_version"), "causation_id", "correlation_id", F.array_join("tags", ",").alias("tags"))


def _roundtrip(fmt):
    def run(spark, folder):
        scratch = Scratch(spark, f"roundtrip-{fmt}")
        write_log(event_log(spark, folder), scratch.path("log"), fmt, by_bucket=4 if fmt != "json" else None)
        back = read_log(spark, scratch.path("log"), fmt)
        return back.select(*KEY, "event_type", "data", "epoch_us", F.array_join("tags", ",").alias("tags"), F.col("metadata")["actor_id"].alias("actor_id"))

    return run


for _fmt in ("parquet", "orc", "json"):
    query(EV + "SELECT stream_id, version, event_id, event_type, data, epoch_us, array_to_string(tags, ',') AS tags, metadata['actor_id'] AS actor_id FROM ev", f"source_{_fmt}")(_roundtrip(_fmt))


# Time travel

@query(EV + f"SELECT stream_id, version, event_id FROM ev WHERE stream_id = '{STREAM}' AND epoch_us <= {AT}")
def temporal_until(spark, folder):
    return temporal.read_until(_ev(spark, folder, "epoch_us"), STREAM, AT).select(*KEY)


@query(EV + f"SELECT stream_id, version, event_id FROM ev WHERE stream_id = '{STREAM}' AND epoch_us <= {AT} ORDER BY version DESC LIMIT 10")
def temporal_until_newest(spark, folder):
    return temporal.read_until(_ev(spark, folder, "epoch_us"), STREAM, AT, "backward", 10).select(*KEY)


@query(EV + f"SELECT stream_id, version, event_id FROM ev WHERE stream_id = '{STREAM}' AND epoch_us BETWEEN {AT} AND {UNTIL}")
def temporal_range(spark, folder):
    return temporal.read_range(_ev(spark, folder, "epoch_us"), STREAM, AT, UNTIL).select(*KEY)


@query(EV + f"SELECT stream_id, version, event_id FROM ev WHERE stream_id LIKE 'orders-%' AND epoch_us BETWEEN {AT} AND {UNTIL}")
def temporal_range_pattern(spark, folder):
    return temporal.read_range(_ev(spark, folder, "epoch_us"), "orders-*", AT, UNTIL).select(*KEY)


@query(EV + f"SELECT stream_id, coalesce(max(version) FILTER (epoch_us <= {AT}), -1) AS version FROM ev GROUP BY stream_id")
def temporal_versions_at(spark, folder):
    return temporal.versions_at(_ev(spark, folder, "epoch_us"), AT)


@query(EV + """, req AS (SELECT DISTINCT stream_id, epoch_us(recorded_at) AS at FROM run_offsets)
SELECT r.stream_id, r.at, coalesce(max(version), -1) AS version FROM req r LEFT JOIN ev ON ev.stream_id = r.stream_id AND ev.epoch_us <= r.at GROUP BY ALL""")
def temporal_versions_as_of(spark, folder):
    req = table(spark, folder, "run_offsets").select("stream_id", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("at"))
    return temporal.versions_as_of(_ev(spark, folder, "epoch_us"), req)


# Folds.  Ops in SQL: one row per top-level field of an object.

_OPS = """, obj AS (SELECT stream_id, version, epoch_us, js AS data FROM ev WHERE json_type(js) = 'OBJECT'),
fld AS (SELECT stream_id AS g, version AS p, epoch_us, k AS field, json_extract(data, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(data)) AS k FROM obj)),
kind AS (SELECT *, json_type(v) AS t, CASE WHEN json_type(v) = 'OBJECT' AND len(json_keys(v)) = 1 THEN json_keys(v)[1] END AS tag FROM fld),
ops AS (SELECT g, p, epoch_us, field,
  CASE WHEN tag = 'sum' AND json_type(v, '$.sum') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(v ->> '$.sum' AS DECIMAL(38,6)) END AS delta,
  CASE WHEN tag = 'overwrite' THEN v -> '$.overwrite' ELSE v END AS val FROM kind),
opn AS (SELECT g, p, epoch_us, field, delta, CASE WHEN delta IS NULL THEN CAST(val AS VARCHAR) END AS txt, CASE WHEN delta IS NULL AND json_type(val) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(CAST(val AS VARCHAR) AS DECIMAL(38,6)) END AS num FROM ops)
"""


def fold_sql(order: str, where: str = "true") -> str:
    return EV + _OPS + f""", src AS (SELECT *, {order} AS o FROM opn WHERE {where}),
last_set AS (SELECT g, field, max(o) AS o FROM src WHERE delta IS NULL GROUP BY ALL),
base AS (SELECT s.g, s.field, s.o, s.num, s.txt FROM src s JOIN last_set l ON s.g = l.g AND s.field = l.field AND s.o = l.o),
tail AS (SELECT s.g, s.field, sum(s.delta) AS d FROM src s LEFT JOIN last_set l ON s.g = l.g AND s.field = l.field WHERE s.delta IS NOT NULL AND (l.o IS NULL OR s.o > l.o) GROUP BY ALL),
ks AS (SELECT DISTINCT g, field FROM src)
SELECT k.g AS stream_id, k.field, CAST(CASE WHEN t.d IS NOT NULL THEN coalesce(b.num, 0) + t.d ELSE b.num END AS DOUBLE) AS number, CASE WHEN t.d IS NULL AND b.num IS NULL THEN b.txt END AS text
FROM ks k LEFT JOIN base b ON b.g = k.g AND b.field = k.field LEFT JOIN tail t ON t.g = k.g AND t.field = k.field"""


def _state(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("group").alias("stream_id"), "field", F.col("number").cast("double").alias("number"), F.when(F.col("number").isNull(), F.col("value")).alias("text"))


@query(fold_sql("p"))
def fold_forward(spark, folder):
    return _state(fold.tagged_fold(fold.fold_ops(_ev(spark, folder, "data"))))


@query(fold_sql("-p"))
def fold_backward(spark, folder):
    return _state(fold.tagged_fold(fold.fold_ops(_ev(spark, folder, "data")), "backward"))


@query(fold_sql("p", f"epoch_us <= {AT}"))
def fold_as_of(spark, folder):
    """State of every stream as of a time."""
    return _state(fold.tagged_fold(fold.fold_ops(_ev(spark, folder, "data", "epoch_us").where(F.col("epoch_us") <= AT))))


@query(EV.replace("WITH ev AS", "WITH ev0 AS") + """, lat AS (SELECT stream_id AS ls, version AS lv, data AS ld FROM snapshots QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY version DESC, timestamp_ms DESC, data DESC NULLS LAST) = 1),
ev AS (SELECT stream_id, version, epoch_us, js FROM ev0 LEFT JOIN lat ON ls = stream_id WHERE lv IS NULL OR version > lv UNION ALL SELECT ls, -1, 0, CASE WHEN json_valid(ld) THEN ld END FROM lat)
""" + fold_sql("p").replace(EV, ""))
def fold_from_snapshots(spark, folder):
    return _state(fold.aggregate_state(_ev(spark, folder, "data"), snapshots.load(table(spark, folder, "snapshots"))))


@query(EV + """, v AS (SELECT stream_id, CASE WHEN json_type(js) = 'OBJECT' THEN js -> '$.amount' END AS a FROM ev)
SELECT stream_id, CAST(coalesce(sum(CASE WHEN json_type(a) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(CAST(a AS VARCHAR) AS DECIMAL(38,6)) WHEN json_type(a) = 'OBJECT' AND json_type(a, '$.sum') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(a ->> '$.sum' AS DECIMAL(38,6)) END), 0) AS DOUBLE) AS total FROM v GROUP BY stream_id""")
def sum_field(spark, folder):
    return fold.sum_field(_ev(spark, folder, "data"), "amount", "stream_id").select("stream_id", F.col("total").cast("double").alias("total"))


@query(EV + """SELECT stream_id, count(*) FILTER (json_type(js) = 'OBJECT' AND CAST(js -> '$.status' AS VARCHAR) = '"open"') AS n FROM ev GROUP BY stream_id""")
def count_where(spark, folder):
    return fold.count_where(_ev(spark, folder, "data"), "status", '"open"', "stream_id")


@query(EV + """, k AS (SELECT stream_id, CASE WHEN json_type(js) = 'OBJECT' THEN json_keys(js) END AS ks FROM ev),
u AS (SELECT stream_id, count(DISTINCT x) AS n FROM (SELECT stream_id, unnest(ks) AS x FROM k) GROUP BY 1)
SELECT k.stream_id, count(*) AS total_events, count(*) FILTER (len(ks) > 0) AS events_with_data, coalesce(max(u.n), 0) AS unique_fields FROM k LEFT JOIN u USING (stream_id) GROUP BY k.stream_id""")
def aggregation_stats(spark, folder):
    return fold.aggregation_stats(_ev(spark, folder, "data"), "stream_id")


@query("SELECT 'order-' || l_orderkey AS stream_id, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def fold_orders(spark, folder):
    ops = order_ops(table(spark, folder, "orders"), table(spark, folder, "lineitem"))
    state = fold.tagged_fold(ops.where("field IN ('amount', 'quantity')")).groupBy("group").agg(*[F.max(F.when(F.col("field") == f, F.col("number"))).cast("double").alias(f) for f in ("amount", "quantity")])
    return state.where("amount is not null").select(F.col("group").alias("stream_id"), "amount", "quantity")


@query("""SELECT 'user-' || user_id AS stream_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS number FROM events GROUP BY 1""")
def merge_tagged(spark, folder):
    """Key and value pairs applied in order to an empty state."""
    e = table(spark, folder, "events")
    pairs = e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("group"), F.col("event_id").alias("position"), F.lit("value").alias("field"), F.format_string('{"sum":%s}', F.col("value").cast("decimal(18,2)").cast("string")).alias("value"))
    return fold.merge_tagged(pairs).select(F.col("group").alias("stream_id"), F.col("number").cast("double").alias("number"))


@query("""SELECT stream_id, version, timestamp_ms, CAST(data ->> '$.balance' AS DOUBLE) AS balance, CAST(data ->> '$.seen' AS BIGINT) AS seen FROM snapshots WHERE data IS NOT NULL""")
def finalize_state(spark, folder):
    """Snapshots written as tagged values and unwrapped again."""
    s = table(spark, folder, "snapshots").where("data is not null")
    tagged = F.create_map(F.lit("balance"), F.concat(F.lit('{"sum":'), F.get_json_object("data", "$.balance"), F.lit("}")), F.lit("seen"), F.concat(F.lit('{"overwrite":'), F.get_json_object("data", "$.seen"), F.lit("}")))
    out = s.select("stream_id", "version", "timestamp_ms", fold.finalized(tagged).alias("m"))
    return out.select("stream_id", "version", "timestamp_ms", F.col("m")["balance"].cast("double").alias("balance"), F.col("m")["seen"].cast("long").alias("seen"))


# Causation

@query(EV + "SELECT causation_id AS event_id, count(*) AS effects, min(epoch_us) AS first_effect_us FROM ev WHERE causation_id <> '' GROUP BY 1")
def effect_counts(spark, folder):
    return causation.effect_counts(_ev(spark, folder, "causation_id", "epoch_us"))


@query(EV + """SELECT c.event_id, CASE WHEN coalesce(c.causation_id, '') = '' THEN 'no_cause' WHEN p.event_id IS NULL THEN 'not_found' ELSE 'found' END AS status, p.event_id AS cause_id, p.stream_id AS cause_stream, p.version AS cause_version, p.event_type AS cause_type
FROM ev c LEFT JOIN ev p ON p.event_id = c.causation_id AND c.causation_id <> ''""")
def event_causes(spark, folder):
    return causation.causes(_ev(spark, folder, "causation_id", "event_type"))


def _deepest(log):
    """An event chosen by rule: of those with a cause the one with the largest id."""
    return log.where("causation_id <> ''").agg(F.max("event_id")).first()[0]


_CHAIN = EV.replace("WITH ev", "WITH RECURSIVE ev") + """, up AS (SELECT event_id, causation_id, 0 AS d FROM ev WHERE event_id = (SELECT max(event_id) FROM ev WHERE causation_id <> '')
UNION ALL SELECT p.event_id, p.causation_id, d + 1 FROM up JOIN ev p ON p.event_id = up.causation_id WHERE d < 1000)
SELECT event_id, CAST((SELECT max(d) FROM up) - d AS INTEGER) AS depth FROM up"""


@query(_CHAIN)
def causation_chain(spark, folder):
    log = _ev(spark, folder, "causation_id")
    return causation.get_chain(log, _deepest(log)).select("event_id", F.col("depth").cast("int").alias("depth"))


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE causation_id = (SELECT min(causation_id) FROM ev WHERE causation_id <> '')")
def effects_of_one(spark, folder):
    log = _ev(spark, folder, "causation_id", "epoch_us")
    return causation.get_effects(log, log.where("causation_id <> ''").agg(F.min("causation_id")).first()[0]).select(*KEY)


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE correlation_id = (SELECT min(correlation_id) FROM ev)")
def correlated_events(spark, folder):
    log = _ev(spark, folder, "correlation_id", "epoch_us")
    return causation.get_correlated(log, log.agg(F.min("correlation_id")).first()[0]).select(*KEY)


@query(EV + """, m AS (SELECT c.correlation_id, c.event_id, c.epoch_us, c.stream_id, c.version, p.event_id AS parent FROM ev c LEFT JOIN ev p ON p.correlation_id = c.correlation_id AND p.event_id = c.causation_id AND c.causation_id <> '' WHERE c.correlation_id IS NOT NULL)
SELECT correlation_id, count(*) AS events, count(parent) AS links, count(*) - count(parent) AS roots, first(event_id ORDER BY epoch_us, stream_id, version) FILTER (parent IS NULL) AS root FROM m GROUP BY correlation_id""")
def correlation_graphs(spark, folder):
    return causation.correlation_graphs(_ev(spark, folder, "causation_id", "correlation_id", "epoch_us"))


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE metadata['source'] = 'batch'")
def metadata_scan(spark, folder):
    return causation.scan_for_metadata(_ev(spark, folder, "metadata", "epoch_us"), "source", "batch").select(*KEY)


@query(EV + "SELECT c.causation_id AS src, c.event_id AS dst FROM ev c WHERE c.causation_id <> '' AND c.causation_id IN (SELECT event_id FROM ev)")
def graph_edges(spark, folder):
    log = _ev(spark, folder, "causation_id")
    return graph.build_edges(log.select(F.col("event_id").alias("id"), F.when(F.col("causation_id") != "", F.col("causation_id")).alias("cause")))


@query(EV + ", g AS (SELECT event_id, causation_id FROM ev WHERE correlation_id = (SELECT min(correlation_id) FROM ev)) SELECT count(*) AS nodes, count(*) FILTER (causation_id IN (SELECT event_id FROM g)) AS edges FROM g")
def correlation_graph_of_one(spark, folder):
    log = _ev(spark, folder, "causation_id", "correlation_id", "epoch_us")
    nodes, edges, _ = causation.build_graph(log, log.agg(F.min("correlation_id")).first()[0])
    e = edges.agg(F.count(F.lit(1)).alias("edges")).first().edges
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.lit(e).cast("long").alias("edges"))


def _trade(spark, folder):
    """A graph in layers: customers lead to parts they bought, parts to suppliers."""
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    c, p, s = (lambda x, k: F.concat(F.lit(k), x.cast("string"))), "p", "s"
    first = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(c(F.col("o_custkey"), "c").alias("src"), c(F.col("l_partkey"), p).alias("dst"))
    edges = first.union(li.select(c(F.col("l_partkey"), p), c(F.col("l_suppkey"), s))).distinct()
    nodes = table(spark, folder, "customer").select(c(F.col("c_custkey"), "c").alias("node")).union(table(spark, folder, "part").select(c(F.col("p_partkey"), p))).union(table(spark, folder, "supplier").select(c(F.col("s_suppkey"), s)))
    return nodes, edges


_TRADE = """WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)),
nodes AS (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier)
"""


@query(_TRADE + "SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM edges)")
def graph_roots(spark, folder):
    return graph.find_roots(*_trade(spark, folder))


@query(_TRADE + "SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges)")
def graph_leaves(spark, folder):
    return graph.find_leaves(*_trade(spark, folder))


@query(_TRADE + ", lv AS (SELECT node, 0 AS l FROM nodes UNION SELECT dst, l + 1 FROM lv JOIN edges ON src = node) SELECT node, CAST(max(l) AS INTEGER) AS level FROM lv GROUP BY node")
def graph_topo_levels(spark, folder):
    return graph.topo_levels(*_trade(spark, folder))[0]


@query(_TRADE + """, d AS (SELECT node, 0 AS k FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION SELECT dst, k + 1 FROM d JOIN edges ON src = node)
SELECT (SELECT count(DISTINCT node) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT dst FROM edges)) AS roots, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT src FROM edges)) AS leaves,
CAST((SELECT max(m) FROM (SELECT node, min(k) AS m FROM d GROUP BY node)) AS BIGINT) AS max_depth""")
def graph_stats(spark, folder):
    return graph.graph_stats(*_trade(spark, folder))


@query(_TRADE + ", a AS (SELECT 's1' AS node, 0 AS k UNION SELECT src, k + 1 FROM a JOIN edges ON dst = node) SELECT node, CAST(min(k) AS INTEGER) AS distance FROM a WHERE node <> 's1' GROUP BY node")
def graph_ancestors(spark, folder):
    return graph.ancestors(_trade(spark, folder)[1], "s1")


@query(_TRADE + ", a AS (SELECT 'c1' AS node, 0 AS k UNION SELECT dst, k + 1 FROM a JOIN edges ON src = node) SELECT node, CAST(min(k) AS INTEGER) AS distance FROM a WHERE node <> 'c1' GROUP BY node")
def graph_descendants(spark, folder):
    return graph.descendants(_trade(spark, folder)[1], "c1")


@query(_TRADE + ", a AS (SELECT 'c1' AS node UNION SELECT dst FROM a JOIN edges ON src = node) SELECT s_suppkey, ('s' || s_suppkey) IN (SELECT node FROM a) AS reached FROM supplier")
def graph_has_path(spark, folder):
    edges = _trade(spark, folder)[1]
    r = graph.reach(edges, spark.createDataFrame([("c1",)], "start string")).select("node")
    s = table(spark, folder, "supplier")
    return s.join(r, F.concat(F.lit("s"), F.col("s_suppkey").cast("string")) == F.col("node"), "left").select("s_suppkey", F.col("node").isNotNull().alias("reached"))


@query(_TRADE + """SELECT 1 AS part, '  "' || node || '" [label="' || substr(node, 1, 1) || '"];' AS line FROM nodes UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '";' FROM edges""")
def graph_dot(spark, folder):
    nodes, edges = _trade(spark, folder)
    return graph.dot_lines(nodes.withColumn("type", F.substring("node", 1, 1)), edges)


@query(EV.replace("WITH ev", "WITH RECURSIVE ev") + """, e AS (SELECT DISTINCT p.event_type AS src, c.event_type AS dst FROM ev c JOIN ev p ON c.causation_id = p.event_id WHERE p.event_type IS NOT NULL AND c.event_type IS NOT NULL),
w AS (SELECT src AS start, dst AS node FROM e UNION SELECT w.start, e.dst FROM w JOIN e ON e.src = w.node) SELECT count(*) > 0 AS has_cycle FROM w WHERE start = node""")
def graph_has_cycle(spark, folder):
    """Do event types cause each other in a circle?  (They do: some cause their own type.)"""
    log = _ev(spark, folder, "causation_id", "event_type").where("event_type is not null")
    p = log.select(F.col("event_id").alias("p_id"), F.col("event_type").alias("src"))
    e = log.join(p, F.col("causation_id") == F.col("p_id")).select("src", F.col("event_type").alias("dst")).distinct()
    n = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return spark.createDataFrame([(graph.has_cycle(n, e),)], "has_cycle boolean")


# Links

@query(EV + """, n AS (SELECT stream_id, count(*) AS n FROM ev GROUP BY 1)
SELECT link_name, coalesce(sum(n), 0)::BIGINT AS events, count(n) AS streams FROM links LEFT JOIN n ON CASE source.type WHEN 'stream' THEN n.stream_id = source.stream_id
 WHEN 'stream_pattern' THEN regexp_matches(n.stream_id, '^' || replace(source.pattern, '*', '.*') || '$') WHEN 'all' THEN NOT starts_with(n.stream_id, '$link:') END GROUP BY link_name""")
def link_sources(spark, folder):
    return links.link_matches(_ev(spark, folder), table(spark, folder, "links"))


LINK = links.Link("big-orders", links.Source("stream_pattern", pattern="orders-*"), filter=lambda df: F.get_json_object("data", "$.qty").try_cast("long") >= 20, transform=lambda df: {"event_type": F.upper("event_type")})


@query(EV + """, s AS (SELECT * FROM ev WHERE regexp_matches(stream_id, '^orders-.*$') AND TRY_CAST(js ->> '$.qty' AS BIGINT) >= 20)
SELECT '$link:big-orders' AS stream_id, row_number() OVER (ORDER BY stream_id, version, event_id) - 1 AS version, event_id, upper(event_type) AS event_type, stream_id AS source_stream, CAST(version AS VARCHAR) AS source_version, metadata['actor_id'] AS actor_id FROM s""")
def link_copies(spark, folder):
    out = links.copies(_ev(spark, folder, "event_type", "data", "metadata"), LINK)
    m = F.col("metadata")
    return out.select("stream_id", "version", "event_id", "event_type", m["source_stream"].alias("source_stream"), m["source_version"].alias("source_version"), m["actor_id"].alias("actor_id"))


# Schemas

def _registry(spark, folder):
    """Every type of event_schemas at its version; a few types have no step from the second version."""
    r = schema_registry.SchemaRegistry()
    steps = {1: schema_registry.add_field("currency", '"EUR"'), 2: schema_registry.rename_field("status", "state")}
    valid = lambda d: F.get_json_object(d, "$.qty").isNotNull()
    for x in table(spark, folder, "event_schemas").groupBy("event_type").agg(F.max("version").alias("version")).collect():
        own = {k: f for k, f in steps.items() if k < x.version and not (k == 2 and x.event_type.startswith("K"))}
        r.register(x.event_type, schema_registry.EventSchema(x.version, own, validator=valid, registered_at=0))
    return r


_REGISTERED = EV + """, s AS (SELECT event_type AS t, max(version) AS reg FROM event_schemas GROUP BY 1),
v AS (SELECT event_id, event_type, coalesce(reg, 0) AS reg, CASE WHEN TRY_CAST(metadata['schema_version'] AS INTEGER) > 0 THEN TRY_CAST(metadata['schema_version'] AS INTEGER) ELSE 1 END AS v, js AS data FROM ev LEFT JOIN s ON t = event_type)"""


@query(_REGISTERED + """, o AS (SELECT *, json_type(data) = 'OBJECT' AS obj, reg >= 3 AND event_type NOT LIKE 'K%' AS second FROM v)
SELECT event_id, CAST(CASE WHEN second AND v <= 2 THEN 3 WHEN reg >= 2 AND v = 1 THEN 2 ELSE v END AS INTEGER) AS version,
 CASE WHEN obj THEN CASE WHEN reg >= 2 AND v = 1 THEN coalesce(data ->> '$.currency', 'EUR') ELSE data ->> '$.currency' END END AS currency,
 CASE WHEN obj AND second AND v <= 2 THEN coalesce(data ->> '$.status', data ->> '$.state') WHEN obj THEN data ->> '$.state' END AS state FROM o""")
def schema_upcast(spark, folder):
    up = _registry(spark, folder).upcast(_ev(spark, folder, "event_type", "metadata", "data"))
    j = lambda f: F.get_json_object("data", f"$.{f}")
    return up.select("event_id", schema_registry.version_of(F.col("metadata")).alias("version"), j("currency").alias("currency"), j("state").alias("state"))


@query(_REGISTERED + "SELECT event_id, CASE WHEN reg > 0 THEN (data ->> '$.qty') IS NOT NULL ELSE true END AS valid FROM v")
def schema_validate(spark, folder):
    return _registry(spark, folder).validated(_ev(spark, folder, "event_type", "data")).select("event_id", "valid")


@query(EV + """, s AS (SELECT event_type AS t, max(version) AS reg FROM event_schemas GROUP BY 1), v AS (SELECT event_type, CASE WHEN TRY_CAST(metadata['schema_version'] AS INTEGER) > 0 THEN TRY_CAST(metadata['schema_version'] AS INTEGER) ELSE 1 END AS v FROM ev)
SELECT CASE WHEN reg IS NULL THEN 'unregistered' WHEN v < reg THEN 'behind' WHEN v = reg THEN 'current' ELSE 'newer' END AS state, event_type, count(*) AS events FROM v LEFT JOIN s ON t = event_type GROUP BY ALL""")
def schema_states(spark, folder):
    return schema_registry.schema_state(_ev(spark, folder, "event_type", "metadata"), table(spark, folder, "event_schemas")).groupBy("state", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT event_type, version, registered_at FROM event_schemas")
def schema_list(spark, folder):
    """The stored schemas through a registry and back."""
    r = schema_registry.SchemaRegistry()
    for x in table(spark, folder, "event_schemas").collect():
        r.register(x.event_type, schema_registry.EventSchema(x.version, description=x.description, registered_at=x.registered_at))
    return r.table(spark).select("event_type", "version", "registered_at")


# Snapshots

_SNAP = """WITH cur AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY stream_id, version ORDER BY timestamp_ms DESC, data DESC NULLS LAST) = 1)
"""


@query(_SNAP + "SELECT stream_id, version, data, timestamp_ms FROM cur")
def snapshots_current(spark, folder):
    return snapshots.current(table(spark, folder, "snapshots")).select("stream_id", "version", "data", "timestamp_ms")


@query(_SNAP + "SELECT stream_id, version, data, timestamp_ms FROM cur QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY version DESC) = 1")
def snapshots_load(spark, folder):
    return snapshots.load(table(spark, folder, "snapshots")).select("stream_id", "version", "data", "timestamp_ms")


@query(_SNAP + f"SELECT stream_id, version, data FROM cur WHERE stream_id = '{STREAM}' AND version = (SELECT min(version) FROM cur WHERE stream_id = '{STREAM}')")
def snapshots_load_at(spark, folder):
    s = table(spark, folder, "snapshots")
    v = s.where(F.col("stream_id") == STREAM).agg(F.min("version")).first()[0]
    return snapshots.load_at(s, STREAM, v).select("stream_id", "version", "data")


@query(_SNAP + f"SELECT stream_id, version FROM cur WHERE stream_id = '{STREAM}'")
def snapshots_list(spark, folder):
    return snapshots.list_snapshots(table(spark, folder, "snapshots"), STREAM).select("stream_id", "version")


@query(_SNAP + "SELECT stream_id, version FROM cur QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY version DESC) <= 2")
def snapshots_newest(spark, folder):
    return snapshots.newest(table(spark, folder, "snapshots"), 2).select("stream_id", "version")


@query(_SNAP + "SELECT stream_id, count(*) AS snapshots, coalesce(sum(strlen(data)), 0)::BIGINT AS bytes FROM cur GROUP BY 1")
def snapshots_sizes(spark, folder):
    return snapshots.sizes(table(spark, folder, "snapshots"))


@query(f"SELECT stream_id, version, timestamp_ms FROM snapshots WHERE stream_id <> '{STREAM}'")
def snapshots_delete(spark, folder):
    return snapshots.delete(table(spark, folder, "snapshots"), STREAM).select("stream_id", "version", "timestamp_ms")


@query(_SNAP + "SELECT stream_id, version, CASE WHEN version % 2 = 0 THEN '{}' ELSE data END AS data FROM cur")
def snapshots_save(spark, folder):
    """Every second version saved again a second later."""
    s = table(spark, folder, "snapshots")
    again = snapshots.current(s).where("version % 2 = 0").withColumns({"data": F.lit("{}"), "timestamp_ms": F.col("timestamp_ms") + 1000})
    return snapshots.save(s, again).select("stream_id", "version", "data")


# Retention

def _plan_sql(cut: str, keep: int, need_snapshot: bool, match: str = "true") -> str:
    allowed = "stream_id IN (SELECT stream_id FROM snapshots)" if need_snapshot else "true"
    return EV + f""", h AS (SELECT stream_id, least(coalesce({cut}, -1), max(version) - {keep}) AS upto FROM ev WHERE {match} GROUP BY stream_id),
c AS (SELECT h.stream_id AS s, count(*) AS n, min(version) AS a, max(version) AS z FROM h JOIN ev ON ev.stream_id = h.stream_id AND version <= upto WHERE h.{allowed} GROUP BY 1)
SELECT stream_id, CASE WHEN {allowed} THEN 'ok' ELSE 'no_snapshot' END AS status, coalesce(n, 0) AS deleted_count, a AS from_version, z AS to_version FROM h LEFT JOIN c ON s = stream_id""".replace("h.true", "true")


@query(_plan_sql(f"max(version) FILTER (epoch_us <= {AT})", 0, True))
def scavenge_before_time(spark, folder):
    return retention.plan(_ev(spark, folder, "epoch_us"), table(spark, folder, "snapshots"), retention.Scavenge(before=AT))


@query(_plan_sql("5 - 1", 2, False))
def scavenge_before_version(spark, folder):
    return retention.plan(_ev(spark, folder, "epoch_us"), table(spark, folder, "snapshots"), retention.Scavenge(before_version=5, keep=2, require_snapshot=False))


@query("SELECT *, true AS dry_run, CASE WHEN from_version IS NOT NULL THEN 'main/' || stream_id || '/' || from_version || '-' || to_version || '.archive' END AS archive_key FROM (" + _plan_sql("10 - 1", 0, False, "regexp_matches(stream_id, '^cart.*$')") + ")")
def scavenge_matching_dry_run(spark, folder):
    return retention.plan(_ev(spark, folder, "epoch_us"), table(spark, folder, "snapshots"), retention.Scavenge(before_version=10, require_snapshot=False), "cart*", True, "main")


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE NOT (stream_id IN (SELECT stream_id FROM snapshots) AND version < 5)")
def log_after_scavenge(spark, folder):
    log = _ev(spark, folder, "epoch_us")
    done = retention.plan(log, table(spark, folder, "snapshots"), retention.Scavenge(before_version=5))
    return retention.scavenged(log, done).select(*KEY)


@query("SELECT stream_id, run_id, from_version, 'main/' || stream_id || '/' || from_version || '-' || to_version || '.archive' AS key, NOT contains(stream_id, '/') AS parses FROM run_offsets")
def archive_keys(spark, folder):
    k = table(spark, folder, "run_offsets").withColumn("key", key_column("main", F.col("stream_id"), F.col("from_version"), F.col("to_version")))
    return k.select("stream_id", "run_id", "from_version", "key", parsed_key(F.col("key")).isNotNull().alias("parses"))


# Subscriptions

@query(EV + """, m AS (SELECT s.id, ev.version FROM subscriptions s JOIN ev ON CASE selector_type WHEN 'stream' THEN selector = '$all' OR ev.stream_id = selector WHEN 'event_type' THEN event_type = selector
 WHEN 'event_pattern' THEN event_type = (selector ->> '$.event_type') WHEN 'event_payload' THEN json_type(js) = 'OBJECT' AND CAST(js -> '$.status' AS VARCHAR) = CAST(selector -> '$.status' AS VARCHAR) END)
SELECT s.id, count(m.id) AS events, max(m.version) AS last_version FROM subscriptions s LEFT JOIN m ON m.id = s.id GROUP BY s.id""")
def subscription_counts(spark, folder):
    return subscriptions.subscription_counts(_ev(spark, folder, "event_type", "data"), table(spark, folder, "subscriptions"))


@query(EV + f"SELECT stream_id, version, event_id FROM ev WHERE stream_id = '{STREAM}'")
def subscription_by_stream(spark, folder):
    return subscriptions.matching(_ev(spark, folder), "stream", STREAM).select(*KEY)


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE event_type = 'OrderPriced'")
def subscription_by_event_type(spark, folder):
    return subscriptions.matching(_ev(spark, folder, "event_type"), "event_type", "OrderPriced").select(*KEY)


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE event_type = 'OrderPriced' AND version = 3")
def subscription_by_pattern(spark, folder):
    return subscriptions.matching(_ev(spark, folder, "event_type"), "event_pattern", {"event_type": "OrderPriced", "version": 3}).select(*KEY)


@query(EV + "SELECT stream_id, version, event_id FROM ev WHERE CASE WHEN json_type(js) = 'OBJECT' AND json_type(js, '$.qty') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(js ->> '$.qty' AS DOUBLE) > 30 END")
def subscription_by_payload(spark, folder):
    return subscriptions.matching(_ev(spark, folder, "data"), "event_payload", {"qty": {"gt": 30}}).select(*KEY)


@query()
def subscription_emitters(spark, folder):
    """Events of each worker of a pool of four."""
    return _ev(spark, folder).groupBy(subscriptions.emitter_of(F.col("event_id"), 4).alias("worker")).agg(F.count(F.lit(1)).alias("events"))


# Flow control

def _queue_sql(down: bool) -> str:
    return EV + f"SELECT stream_id, version, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY version {'DESC' if down else 'ASC'}) <= 50"


@query(_queue_sql(True))
def queue_drop_oldest(spark, folder):
    return flow.bounded_batch(_ev(spark, folder), ["stream_id"], ["version"], 50, "drop_oldest").select(*KEY)


@query(_queue_sql(False))
def queue_drop_newest(spark, folder):
    return flow.bounded_batch(_ev(spark, folder), ["stream_id"], ["version"], 50, "drop_newest").select(*KEY)


@query(EV + "SELECT stream_id, count(*) AS offered, least(count(*), 50) AS held, count(*) - least(count(*), 50) AS dropped, least(count(*), 50) / 50.0::DOUBLE AS utilization, count(*) > 40 AS warned FROM ev GROUP BY 1")
def queue_overflow(spark, folder):
    return flow.overflow(_ev(spark, folder), ["stream_id"], 50)


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) / 10000 >= 0.85 THEN 'critical' WHEN abs(c_acctbal) / 10000 >= 0.70 THEN 'elevated' ELSE 'normal' END AS level FROM customer")
def memory_levels(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", flow.MemoryLevels().column(F.abs("c_acctbal") / 10000).alias("level"))


# Text kernels

@query("SELECT DISTINCT stream_id, regexp_matches(stream_id, '^cart.*$') AS wildcard, regexp_matches(stream_id, '^o.ders-.*$') AS single, regexp_matches(stream_id, '[0-9][a-z]$') AS regex, starts_with(stream_id, 'orders') AS prefix, ends_with(stream_id, '7') AS suffix FROM event_log")
def text_matches(spark, folder):
    s = F.col("stream_id")
    t = table(spark, folder, "event_log").select("stream_id").distinct()
    return t.select("stream_id", text.wildcard_match(s, "cart*").alias("wildcard"), text.wildcard_match(s, "o?ders-*").alias("single"), text.regex_match(s, "[0-9][a-z]$").alias("regex"), text.has_prefix(s, "orders").alias("prefix"), text.has_suffix(s, "7").alias("suffix"))


@query("""SELECT delivery_id, array_to_string(list_filter(list_transform(range(len(tags)), lambda i: CASE WHEN starts_with(tags[i + 1], 'zone:') THEN i END), lambda i: i IS NOT NULL), ',') AS places, len(list_filter(tags, lambda t: starts_with(t, 'zone:'))) AS n FROM event_log WHERE tags IS NOT NULL""")
def text_match_indices(spark, folder):
    test = lambda t: t.startswith("zone:")
    t = table(spark, folder, "event_log").where("tags is not null")
    return t.select("delivery_id", F.array_join(text.match_indices(F.col("tags"), test), ",").alias("places"), text.count_matches(F.col("tags"), test).cast("long").alias("n"))


@query("SELECT DISTINCT stream_id FROM event_log WHERE regexp_matches(stream_id, '^orders-.*$') AND ends_with(stream_id, '4') AND regexp_matches(stream_id, '[a-z]') AND starts_with(stream_id, 'ord')")
def text_filters(spark, folder):
    t = table(spark, folder, "event_log").select("stream_id").distinct()
    t = text.filter_by_suffix(text.filter_by_wildcard(t, "stream_id", "orders-*"), "stream_id", "4")
    return text.filter_by_prefix(text.filter_by_regex(t, "stream_id", "[a-z]"), "stream_id", "ord")


# Hash, digest and compression kernels

@query("""SELECT stream_id, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(stream_id) + 1), lambda i: CAST(ascii(substr(stream_id, i, 1)) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS fnv FROM (SELECT DISTINCT stream_id FROM event_log)""")
def hash_fnv1a(spark, folder):
    return table(spark, folder, "event_log").select("stream_id").distinct().select("stream_id", hashing.fnv1a(F.col("stream_id")).cast("string").alias("fnv"))


@query()
def hash_partitions(spark, folder):
    s = F.col("stream_id")
    t = table(spark, folder, "event_log").select("stream_id").distinct()
    return t.select(hashing.partition_hash(s, 16).alias("a"), hashing.stream_partition("main", s, 16).alias("b"), hashing.fast_phash(s, 16).alias("c"), hashing.xxhash64(s, 7).alias("h"), hashing.xxhash3(s).alias("h3"), hashing.partition_hash_batch(F.array(s), 16)[0].alias("d"))


@query("SELECT DISTINCT event_id, sha256(event_id) AS digest, rtrim(translate(base64(unhex(sha256(event_id))), '+/', '-_'), '=') AS url FROM event_log")
def digest_sha256(spark, folder):
    e = F.col("event_id")
    t = table(spark, folder, "event_log").select("event_id").distinct()
    return t.select("event_id", F.lower(F.hex(codec.sha256(e))).alias("digest"), codec.sha256_base64url(e).alias("url"))


@query("SELECT DISTINCT data, rtrim(translate(base64(encode(data)), '+/', '-_'), '=') AS url, data AS back FROM event_log")
def base64_urlsafe(spark, folder):
    t = table(spark, folder, "event_log").select("data").distinct()
    url = codec.base64url(F.col("data"))
    return t.select("data", url.alias("url"), codec.unbase64url(url).cast("string").alias("back"))


@query("SELECT DISTINCT data, data AS lz4, data AS zstd, data AS zlib FROM event_log")
def compression_roundtrip(spark, folder):
    t = table(spark, folder, "event_log").select("data").distinct()
    return t.select("data", *[codec.decompressed(codec.compressed(F.col("data"), c), c).cast("string").alias(c) for c in codec.CODECS])


# Security and operations

@query("""SELECT run_id, stream_id, from_version, state, stream_id = 'hub-intake' OR (starts_with(stream_id, 'orders-') AND state = 'committed') AS allowed FROM run_offsets""")
def authorize_requests(spark, folder):
    req = table(spark, folder, "run_offsets").select("run_id", "stream_id", "from_version", "state", F.col("stream_id").alias("resource"), F.col("state").alias("action"))
    return security.authorized(req, [("hub-intake", "*"), ("orders-*", "committed")]).select("run_id", "stream_id", "from_version", "state", "allowed")


@query("""SELECT id AS token_id, CASE WHEN created_at // 1000 <= 1543000000 THEN 'expired' WHEN pool_size > 6 AND 1545000000 > 1544000000 THEN 'not_yet_valid' WHEN selector_type = 'stream' THEN 'revoked' ELSE 'valid' END AS state FROM subscriptions""")
def token_states(spark, folder):
    s = table(spark, folder, "subscriptions")
    t = s.select(F.col("id").alias("token_id"), F.col("selector_type").alias("iss"), (F.expr("created_at div 1000") + 1000000).alias("exp"), F.when(F.col("pool_size") > 6, F.lit(1545000000)).alias("nbf"))
    revoked = spark.createDataFrame([("issuer", "stream")], "kind string, value string")
    return security.token_states(t, 1544000000, revoked).select("token_id", "state")


@query("""WITH v AS (SELECT run_id, stream_id AS node, list_sort(list(DISTINCT state)) AS view FROM run_offsets GROUP BY ALL) SELECT run_id AS check_id, count(*) AS nodes, count(DISTINCT view) AS views, CASE WHEN count(DISTINCT view) > 1 THEN 'split_brain' ELSE 'consensus' END AS status FROM v GROUP BY 1""")
def membership_views(spark, folder):
    """Runs as checks, streams as nodes, claim states as the members they see."""
    return operations.membership_views(table(spark, folder, "run_offsets").select(F.col("run_id").alias("check_id"), F.col("stream_id").alias("node"), F.col("state").alias("member")))


@query("SELECT run_id AS check_id, count(DISTINCT state) AS leaders, CASE count(DISTINCT state) WHEN 1 THEN 'consensus' WHEN 0 THEN 'no_leader' ELSE 'disagreement' END AS status FROM run_offsets GROUP BY 1")
def leader_views(spark, folder):
    return operations.leader_views(table(spark, folder, "run_offsets").select(F.col("run_id").alias("check_id"), F.col("stream_id").alias("node"), F.col("state").alias("leader")))


@query("SELECT run_id AS check_id, count(DISTINCT read_to_batch) AS terms, max(to_version) - min(to_version) AS lag, CASE WHEN count(DISTINCT read_to_batch) <= 1 AND max(to_version) - min(to_version) < 100 THEN 'consistent' ELSE 'lagging' END AS status FROM run_offsets GROUP BY 1")
def replication_lag(spark, folder):
    return operations.replication_lag(table(spark, folder, "run_offsets").select(F.col("run_id").alias("check_id"), F.col("stream_id").alias("node"), F.col("read_to_batch").alias("term"), F.col("to_version").alias("commit_index")))


@query("""WITH p AS (SELECT c_custkey AS node, o_orderkey AS "at", o_orderstatus = 'O' AS ok FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY node ORDER BY "at") AS run FROM p),
f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY node, run ORDER BY "at") AS failures FROM r)
SELECT node, "at", ok, failures::BIGINT AS failures, CASE WHEN failures = 0 THEN 'healthy' WHEN failures < 3 THEN 'suspect' ELSE 'failed' END AS state, ok AND coalesce(lag(failures) OVER (PARTITION BY node ORDER BY "at"), 0) >= 3 AS recovered FROM f""")
def probe_states(spark, folder):
    """Orders of a customer as probes of a node, the open ones as successes."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return operations.probe_states(o.select(F.col("c_custkey").alias("node"), F.col("o_orderkey").alias("at"), (F.col("o_orderstatus") == "O").alias("ok")))


@query("""WITH s AS (SELECT DISTINCT batch_id AS "at", event_type AS node FROM event_log WHERE event_type IS NOT NULL), o AS (SELECT "at", row_number() OVER (ORDER BY "at") AS k FROM (SELECT DISTINCT "at" FROM s)), n AS (SELECT node, k FROM s JOIN o USING ("at"))
SELECT "at", node, change FROM (SELECT k + 1 AS k, node, 'removed' AS change FROM n WHERE (node, k + 1) NOT IN (SELECT (node, k) FROM n) AND k < (SELECT max(k) FROM o) UNION ALL SELECT k, node, 'added' FROM n WHERE k > 1 AND (node, k - 1) NOT IN (SELECT (node, k) FROM n)) JOIN o USING (k)""")
def membership_changes(spark, folder):
    """Event types present in each delivery batch as members seen at a time."""
    return operations.membership_changes(table(spark, folder, "event_log").where("event_type is not null").select(F.col("batch_id").alias("at"), F.col("event_type").alias("node")))
