"""Queries that go through stored state: registries, the store, archives, and kernels that need more than one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlog.functions import codec, hashing
from strandlog.operators import archive, causation, graph, links, operations, schema_registry, snapshots, subscriptions
from strandlog.plans.event_store import EV, STREAM
from strandlog.runtime import Scratch
from strandlog.sources.log import event_log
from strandlog.sources.tables import table
from strandlog.store import Store

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _ev(spark, folder, *columns):
    return event_log(spark, folder, ["stream_id", "version", "event_id", *columns])


# Durable definitions: written by one registry, read by another, as by a new driver

@query("""SELECT selector_type, selector, subscription_name, CASE WHEN subscription_name = (SELECT min(subscription_name) FROM subscriptions WHERE selector_type IN ('stream', 'event_type')) THEN 7 END::BIGINT AS checkpoint
FROM (SELECT DISTINCT selector_type, selector, subscription_name FROM subscriptions WHERE selector_type IN ('stream', 'event_type') AND selector_type IS NOT NULL)
WHERE subscription_name <> (SELECT max(subscription_name) FROM subscriptions WHERE selector_type IN ('stream', 'event_type'))""")
def subscription_registry(spark, folder):
    """Subscribe, acknowledge every subscription of the first name and drop those of the last; a new registry has the rest."""
    path = Scratch(spark, "registry").path("subscriptions")
    r = subscriptions.SubscriptionRegistry(spark, path)
    rows = table(spark, folder, "subscriptions").where("selector_type IN ('stream', 'event_type')").select("selector_type", "selector", "subscription_name").collect()
    for x in rows:
        try:
            r.subscribe(x.selector_type, x.selector, x.subscription_name)
        except subscriptions.AlreadyExists:
            pass
    names = sorted({x.subscription_name for x in rows})
    if names:
        for s in r.list():
            if s.name == names[-1]:
                r.unsubscribe(s.id)
        for s in r.list():
            if s.name == names[0]:
                r.update(s.id, checkpoint=7)
    again = subscriptions.SubscriptionRegistry(spark, path).table(spark)
    return again.select("selector_type", "selector", "subscription_name", "checkpoint")


@query("""SELECT link_name, source.type AS type, source.stream_id AS source_stream, source.pattern AS pattern, backfill, CASE WHEN lower(trim(status)) = 'running' THEN 'running' ELSE 'stopped' END AS status, processed
FROM links QUALIFY row_number() OVER (PARTITION BY link_name ORDER BY created_at) = 1""")
def link_registry(spark, folder):
    """Create every link of the table, start those that were running, count what they had processed; read back anew."""
    path = Scratch(spark, "registry").path("links")
    r = links.LinkRegistry(spark, path)
    first = table(spark, folder, "links").groupBy("link_name").agg(F.min_by(F.struct("source", "backfill", "created_at", "status", "processed"), "created_at").alias("x"))
    for name, x in first.collect():
        r.create(links.Link(name, links.Source(x.source.type, x.source.stream_id, x.source.pattern), backfill=x.backfill), x.created_at)
        if (x.status or "").strip().lower() == "running":
            r.start(name)
        r.processed(name, x.processed)
    t = links.LinkRegistry(spark, path).table(spark)
    return t.select("link_name", "source.type", F.col("source.stream_id").alias("source_stream"), "source.pattern", "backfill", "status", "processed")


@query("SELECT event_type, max(version) AS version FROM event_schemas WHERE event_type NOT LIKE 'K%' GROUP BY event_type")
def schema_registry_reopened(spark, folder):
    path = Scratch(spark, "registry").path("schemas")
    r = schema_registry.SchemaRegistry(spark, path)
    rows = table(spark, folder, "event_schemas").groupBy("event_type").agg(F.max("version").alias("version")).collect()
    r.register_all({x.event_type: schema_registry.EventSchema(x.version, {1: schema_registry.add_field("a", "1")} if x.version > 1 else {}) for x in rows})
    for t in sorted(x.event_type for x in rows if x.event_type.startswith("K")):
        r.unregister(t)
    return schema_registry.SchemaRegistry(spark, path).table(spark).select("event_type", "version")


# The store

@query("""SELECT 'all-users' AS stream_id, row_number() OVER (ORDER BY event_id) - 1 AS version, CAST(event_id AS VARCHAR) AS event_id, event_type, 'feed' AS source FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'all-users', (SELECT count(*) FROM events WHERE event_type <> 'error') + row_number() OVER (ORDER BY event_id) - 1, CAST(event_id AS VARCHAR), event_type, 'errors' FROM events WHERE event_type = 'error'""")
def store_appends(spark, folder):
    """The user events appended as one stream in two appends with expected versions, a compaction between them; another stream is deleted."""
    store = Store(spark, Scratch(spark, "store").path("main"))
    e = table(spark, folder, "events").orderBy("event_id")

    def new(rows, source):
        return rows.select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("props").alias("data"), F.create_map(F.lit("source"), F.lit(source)).alias("metadata"), F.array().cast("array<string>").alias("tags"))

    last = store.append("all-users", -1, new(e.where("event_type <> 'error'"), "feed"))
    store.append("gone", -2, [{"event_type": "Opened", "data": {}}])
    store.delete("gone")
    store.compact()
    store.vacuum()
    store.append("all-users", last, new(e.where("event_type = 'error'"), "errors"))
    return store.log().select("stream_id", "version", "event_id", "event_type", F.col("metadata")["source"].alias("source"))


@query("SELECT stream_id, version, data FROM snapshots QUALIFY row_number() OVER (PARTITION BY stream_id, version ORDER BY timestamp_ms DESC, data DESC NULLS LAST) = 1 AND NOT (stream_id, version) IN (SELECT stream_id, max(version) FROM snapshots WHERE stream_id = (SELECT min(stream_id) FROM snapshots) GROUP BY stream_id)")
def snapshots_delete_at(spark, folder):
    """The snapshot of the largest version of the first stream deleted, and no other."""
    s = snapshots.current(table(spark, folder, "snapshots"))
    x = s.groupBy("stream_id").agg(F.max("version").alias("version")).orderBy("stream_id").first()
    if x is None:
        return s.select("stream_id", "version", "data")
    left = snapshots.delete(s, x.stream_id, x.version)
    if snapshots.exists(left, x.stream_id, x.version) or not snapshots.exists(s, x.stream_id, x.version):
        raise AssertionError("deleted at a version")
    return left.select("stream_id", "version", "data")


@query(EV + f"SELECT '{STREAM}' AS stream_id, version, event_id, CAST((version - (SELECT min(version) FROM ev WHERE stream_id = '{STREAM}')) // 400 AS BIGINT) AS part FROM ev WHERE stream_id = '{STREAM}' AND version - (SELECT min(version) FROM ev WHERE stream_id = '{STREAM}') < 1200 AND (version - (SELECT min(version) FROM ev WHERE stream_id = '{STREAM}')) // 400 <> 1")
def archive_round_trip(spark, folder):
    """The first 1,200 versions of a stream in three archives; the second is deleted, the first written twice, the rest listed and read."""
    kept = archive.FolderArchive(spark, Scratch(spark, "archives").path("all"))
    one = _ev(spark, folder).where(F.col("stream_id") == STREAM)
    low = one.agg(F.min("version")).first()[0] or 0
    for k in (0, 1, 2, 0):
        a = low + 400 * k
        kept.archive(archive.make_key("main", STREAM, a, a + 399), one.where(F.col("version").between(a, a + 399)))
    kept.delete(archive.make_key("main", STREAM, low + 400, low + 799))
    parts = [kept.read(key).withColumn("part", F.lit((archive.parse_key(key)[2] - low) // 400).cast("long")) for key in kept.list("main", STREAM)]
    return parts[0].unionByName(parts[1]).select("stream_id", "version", "event_id", "part")


# Causes and graphs

_TARGET = "(SELECT min(event_id) FROM ev WHERE correlation_id = (SELECT max(correlation_id) FROM ev))"


@query(EV + f", t AS (SELECT * FROM ev WHERE event_id = {_TARGET}) SELECT stream_id, version, event_id, event_type FROM t")
def find_event(spark, folder):
    log = _ev(spark, folder, "event_type", "correlation_id")
    top = log.agg(F.max("correlation_id")).first()[0]
    wanted = log.where(F.col("correlation_id") == top).agg(F.min("event_id")).first()[0]
    return causation.find_event_by_id(log, wanted).select("stream_id", "version", "event_id", "event_type")


@query(r"""SELECT 'n' || n_nationkey AS id, '  "n' || n_nationkey || '" [label="' || replace(replace('"' || n_name || '" \ ' || r_name, '\', '\\'), '"', '\"') || '"];' AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_dot_escaped(spark, folder):
    """Node lines whose labels hold quotes and backslashes."""
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit('"'), "n_name", F.lit('" \\ '), "r_name").alias("type"))
    edges = spark.createDataFrame([], "src string, dst string")
    return graph.dot_lines(nodes, edges).where("part = 1").select(F.regexp_extract("line", r'^  "(n[0-9]+)"', 1).alias("id"), "line")


@query("""WITH RECURSIVE n AS (SELECT CAST(r_regionkey AS BIGINT) AS k, (SELECT count(*) FROM region) AS c FROM region),
e AS (SELECT 'ring' AS graph, k AS src, (k + 1) % c AS dst FROM n UNION ALL SELECT 'chain', k, k + 1 FROM n WHERE k + 1 < c),
w AS (SELECT graph, src AS start, dst AS node FROM e UNION SELECT w.graph, w.start, e.dst FROM w JOIN e ON e.graph = w.graph AND e.src = w.node)
SELECT graph, count(*) FILTER (start = node) > 0 AS has_cycle FROM w GROUP BY graph""")
def graph_long_circle(spark, folder):
    """A circle through all regions, without self-loops, and the same chain cut once."""
    n = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    count = n.count()
    nodes = n.select(F.col("k").cast("string").alias("node"))
    ring = n.select(F.col("k").cast("string").alias("src"), ((F.col("k") + 1) % count).cast("string").alias("dst"))
    chain = n.where(F.col("k") + 1 < count).select(F.col("k").cast("string").alias("src"), (F.col("k") + 1).cast("string").alias("dst"))
    return spark.createDataFrame([("ring", graph.has_cycle(nodes, ring)), ("chain", graph.has_cycle(nodes, chain))], "graph string, has_cycle boolean")


# Kernels

@query("SELECT 16 AS partitions, count(DISTINCT stream_id) AS streams, true AS in_range, true AS stable, true AS even FROM event_log")
def hash_invariants(spark, folder):
    """Partitions of all streams lie in range, are the same for the same text, in batches too, and differ little in size."""
    s = F.col("stream_id")
    t = table(spark, folder, "event_log").select("stream_id").distinct()
    p, again = hashing.partition_hash(s, 16), hashing.partition_hash_batch(F.array(F.concat(s, F.lit(""))), 16)[0]
    rows = t.select(p.alias("p"), (p == again).alias("same"), hashing.stream_partition("main", s, 16).alias("q"), hashing.fast_phash(s, 16).alias("r"))
    per = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("same"), F.min(F.least("p", "q", "r")).alias("low"), F.max(F.greatest("p", "q", "r")).alias("high"))
    return per.agg(F.lit(16).alias("partitions"), F.sum("n").alias("streams"), ((F.min("low") >= 0) & (F.max("high") < 16)).alias("in_range"), F.min("same").alias("stable"), (F.max("n") < 4 * F.sum("n") / 16 + 10).alias("even"))


@query(EV + "SELECT count(*) AS events, 4 AS workers, true AS one_worker_each FROM ev")
def emitter_workers(spark, folder):
    """Every event has exactly one of four workers, the same at each delivery."""
    t = table(spark, folder, "event_log").where("event_id is not null").select("event_id", subscriptions.emitter_of(F.col("event_id"), 4).alias("worker")).distinct()
    return t.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("worker").cast("int").alias("workers"), (F.count(F.lit(1)) == F.count_distinct("event_id")).alias("one_worker_each"))


@query("SELECT codec, count(DISTINCT data) AS texts, CAST(sum(strlen(data)) AS BIGINT) AS original, true AS packed, true AS back FROM (SELECT DISTINCT data FROM event_log WHERE data IS NOT NULL), (SELECT unnest(['lz4', 'zstd', 'zlib']) AS codec) GROUP BY codec")
def compression_sums(spark, folder):
    """Of each codec: it gives back what it got, and its output is neither the input nor as long as all of it packed alone."""
    t = table(spark, folder, "event_log").select("data").where("data IS NOT NULL").distinct()
    out = None
    for c in codec.CODECS:
        packed = codec.compressed(F.col("data"), c)
        x = t.select("data", packed.alias("packed"), codec.compression_sizes(F.repeat("data", 20), c).alias("s"))
        x = x.withColumn("back", codec.decompressed(F.col("packed"), c).cast("string") == F.col("data"))
        small = (F.col("s.compressed") < F.col("s.original") / 2) | (F.length("data") < 8)
        one = x.agg(F.lit(c).alias("codec"), F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("data").cast("long")).alias("original"), F.min(small & (F.col("packed") != F.col("data").cast("binary"))).alias("packed"), F.min("back").alias("back"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey, n_name = 'FRANCE' AS same FROM nation")
def secure_equality(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", codec.secure_equal(F.col("n_name"), F.lit("FRANCE")).alias("same"))


#: The first three test vectors of RFC 8032 (fixed values): public key, message, signature.
RFC_8032 = (
    ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
)


@query("SELECT n_nationkey, n_nationkey % 3 AS vector, n_nationkey % 2 = 0 AS good FROM nation")
def signatures(spark, folder):
    """A signature of the RFC for every nation; of odd ones the message is another."""
    v = spark.createDataFrame([(i, *(bytes.fromhex(x) for x in t)) for i, t in enumerate(RFC_8032)], "vector int, key binary, message binary, signature binary")
    n = table(spark, folder, "nation").select("n_nationkey", (F.col("n_nationkey") % 3).alias("v"))
    n = n.join(v, F.col("v") == F.col("vector")).withColumn("message", F.when(F.col("n_nationkey") % 2 == 1, F.concat("message", F.lit("x").cast("binary"))).otherwise(F.col("message")))
    return n.select("n_nationkey", "vector", codec.ed25519_valid(F.col("message"), F.col("signature"), F.col("key")).alias("good"))


# Operations

@query("""SELECT n_regionkey AS check_id, count(*) AS available, CASE WHEN count(*) FILTER (n_nationkey % 2 = 0) * 2 <= count(*) THEN 'no_quorum' WHEN bool_or(n_name LIKE 'A%') THEN 'degraded' ELSE 'healthy' END AS status,
CAST(count(*) // 2 + 1 AS BIGINT) AS required FROM nation GROUP BY n_regionkey""")
def cluster_status(spark, folder):
    """Nations as nodes of a cluster per region, those of even key being up: quorum and overall state."""
    n = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("check_id")).agg(F.count(F.lit(1)).alias("available"), F.count_if(F.col("n_nationkey") % 2 == 0).alias("up"), F.max(F.col("n_name").startswith("A")).alias("degraded"))
    required = F.floor(F.col("available") / 2).cast("long") + 1
    return n.select("check_id", "available", operations.overall(F.lit(False), F.col("up") >= required, F.col("degraded")).alias("status"), required.alias("required"))
