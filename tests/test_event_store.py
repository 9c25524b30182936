import json
import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators import archive, causation, fold, links, retention, schema_registry, snapshots, streams, subscriptions, temporal
from strandlog.runtime import Scratch, list_names
from strandlog.sources.log import ANY_VERSION, NO_STREAM, canonical
from strandlog.store import Conflict, Store, StoreCatalog

EVENT = "stream_id string, version long, event_id string, event_type string, data string, metadata map<string,string>, tags array<string>, timestamp_ms long, epoch_us long, causation_id string, correlation_id string"


def log_of(spark, rows):
    """Rows as dicts; what is missing is null."""
    names = [x.split(" ")[0] for x in EVENT.split(", ")]
    full = []
    for i, r in enumerate(rows):
        r = {"stream_id": "s", "version": i, "event_id": f"e{i}", "event_type": "T", "data": "{}", "epoch_us": i} | r
        if not isinstance(r["data"], (str, type(None))):
            r["data"] = json.dumps(r["data"])
        full.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(full, EVENT)


def versions(df):
    return [r.version for r in df.collect()]


@pytest.fixture()
def five(spark):
    return log_of(spark, [{"epoch_us": t * 1_000_000} for t in (1, 2, 3, 5, 10)])


def test_reads(spark, five):
    assert versions(streams.read(five, "s", 0, 10)) == [0, 1, 2, 3, 4]
    assert versions(streams.read(five, "s", 4, 10, "backward")) == [4, 3, 2, 1, 0]
    assert versions(streams.read(five, "s", 0, 3)) == [0, 1, 2]
    assert versions(streams.read(five, "s", 100, 3)) == []
    assert versions(streams.read_all(five, "s", 2, "backward")) == [4, 3]
    with pytest.raises(streams.StreamNotFound):
        streams.require_stream(five, "none")
    assert streams.get_version(five, "none") == NO_STREAM and streams.get_version(five, "s") == 4
    assert [r.stream_id for r in streams.list_streams(five).collect()] == ["s"]
    gap = five.where("version not in (0, 2)")
    assert streams.get_version(gap, "s") == 4 and versions(streams.read(gap, "s", 0, 3)) == [1]


def test_tags(spark):
    sets = [["student:456", "course:CS101"], ["student:456", "course:MATH201"], ["student:789", "course:CS101"], ["student:789", "course:PHYS101"], None, []]
    log = log_of(spark, [{"tags": t} for t in sets])
    n = lambda tags, how: streams.read_by_tags(log, tags, how).count()
    assert [n(["student:456"], "any"), n(["course:CS101"], "any"), n(["student:456", "student:789"], "any"), n(["x"], "any"), n([], "any")] == [2, 2, 4, 0, 0]
    assert [n(["student:456"], "all"), n(["student:456", "course:CS101"], "all"), n(["student:456", "student:789"], "all"), n([], "all")] == [2, 1, 0, 0]


def test_temporal(five):
    assert versions(temporal.read_until(five, "s", 3_000_000)) == [0, 1, 2]
    assert versions(temporal.read_range(five, "s", 2_000_000, 5_000_000)) == [1, 2, 3]
    assert versions(temporal.read_until(five, "s", 10_000_000, "backward", 2)) == [4, 3]
    assert temporal.version_at(five, "s", 4_000_000) == 2 and temporal.version_at(five, "s", 0) == -1
    with pytest.raises(ValueError):
        temporal.read_until(five, "s", 1, limit=0)


def test_as_of_join_with_clocks_that_run_back(spark):
    rng = random.Random(1)
    rows = [{"stream_id": s, "version": v, "event_id": f"{s}{v}", "epoch_us": max(0, v * 10 + rng.randrange(-40, 40))} for s in "ab" for v in range(60)]
    ask = [(s, t) for s in "abc" for t in range(-5, 700, 37)] + [("a", 5), ("a", 5), (None, 1), ("a", None)]
    got = {(r.stream_id, r.at): r.version for r in temporal.versions_as_of(log_of(spark, rows), spark.createDataFrame(ask, "stream_id string, at long"), slot_us=64).collect()}
    assert got == {(s, t): max([r["version"] for r in rows if s == r["stream_id"] and t is not None and r["epoch_us"] <= t], default=-1) for s, t in ask}


def sequential(events, state=None, backward=False):
    state = dict(state or {})
    for d in reversed(events) if backward else events:
        if not isinstance(d, dict):
            continue
        for k, v in d.items():
            num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
            if isinstance(v, dict) and len(v) == 1 and num(v.get("sum")):
                old = state.get(k, 0)
                state[k] = (old if num(old) else 0) + v["sum"]
            else:
                state[k] = v["overwrite"] if isinstance(v, dict) and list(v) == ["overwrite"] else v
    return state


def folded(df):
    return {(r.group, r.field): float(r.number) if r.number is not None else json.loads(r.value) for r in df.collect()}


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("block", [3, fold.BLOCK])
def test_fold_equals_a_sequential_one(spark, backward, block):
    rng = random.Random(2)
    values = [lambda: {"sum": rng.randrange(-9, 9)}, lambda: {"overwrite": rng.choice([5, "x", None, [1]])}, lambda: rng.choice([1, 2.5, "text", True, None]), lambda: {"sum": "no"}, lambda: {"sum": 1, "more": 2}]
    events = {s: [rng.choice([{rng.choice("abc"): rng.choice(values)() for _ in range(2)}] * 5 + ["not json", "[1]", "", None]) for _ in range(25)] for s in ("x", "y", "z")}
    rows = [{"stream_id": s, "version": v, "event_id": f"{s}{v}", "data": d} for s, ds in events.items() for v, d in enumerate(ds)]
    got = folded(fold.tagged_fold(fold.fold_ops(log_of(spark, rows)), "backward" if backward else "forward", block=block))
    assert got == {(s, k): v for s, ds in events.items() for k, v in sequential(ds, backward=backward).items()}


def test_fold_examples(spark):
    account = log_of(spark, [{"data": {"name": "J", "balance": {"sum": 0}}}, {"data": {"balance": {"sum": 100}}}, {"data": {"balance": {"sum": -30}}}])
    assert folded(fold.aggregate_state(account)) == {("s", "name"): "J", ("s", "balance"): 70}
    tail = log_of(spark, [{"version": v, "data": {"balance": {"sum": n}}} for v, n in ((4, 999), (6, 100), (7, -50))])
    saved = spark.createDataFrame([("s", 5, '{"name":"J","balance":500}')], "stream_id string, version long, data string")
    assert folded(fold.aggregate_state(tail, saved)) == {("s", "name"): "J", ("s", "balance"): 550}
    simple = log_of(spark, [{"data": {"amount": a, "status": s}} for a, s in ((100, "active"), (200, "inactive"), (150, "active"))])
    assert fold.sum_field(simple, "amount").first().total == 450
    assert fold.count_where(simple, "status", '"active"').first().n == 2
    assert fold.count_where(simple, "nothing", None).first().n == 3
    assert tuple(fold.aggregation_stats(simple).first()) == (3, 3, 2)
    assert fold.sum_field(simple.limit(0), "amount").first().total == 0
    state = spark.createDataFrame([("s", "n", 10.0, "10")], "group string, field string, number double, value string").selectExpr("group", "field", "cast(number as decimal(38,6)) number", "value")
    pairs = spark.createDataFrame([("s", 1, "n", '{"sum":5}'), ("s", 2, "k", '"v"')], "group string, position long, field string, value string")
    assert folded(fold.merge_tagged(pairs, state)) == {("s", "n"): 15, ("s", "k"): "v"}
    m = spark.range(1).select(fold.finalized(F.create_map(F.lit("a"), F.lit('{"sum":4}'), F.lit("b"), F.lit('{"overwrite":"x"}'), F.lit("c"), F.lit("7"))).alias("m")).first().m
    assert m == {"a": "4", "b": '"x"', "c": "7"}


def test_causation(spark):
    rows = [("e0", None), ("e1", "e0"), ("e2", "e1"), ("e3", "e1"), ("lost", "gone"), ("x", "y"), ("y", "x")]
    log = log_of(spark, [{"event_id": i, "causation_id": c, "correlation_id": "saga" if i[0] == "e" else "other"} for i, c in rows])
    assert [r.event_id for r in causation.get_effects(log, "e1").collect()] == ["e2", "e3"]
    assert causation.get_cause(log, "e0")[0] == "no_cause" and causation.get_cause(log, "lost")[0] == "not_found" and causation.get_cause(log, "zz")[0] == "not_found"
    assert causation.get_cause(log, "e2")[1].first().event_id == "e1"
    assert [(r.event_id, r.depth) for r in causation.get_chain(log, "e3").collect()] == [("e0", 0), ("e1", 1), ("e3", 2)]
    assert {r.event_id for r in causation.get_chain(log, "x").collect()} == {"x", "y"}
    nodes, edges, root = causation.build_graph(log, "e3")
    assert root == "e0" and nodes.count() == 4 and edges.count() == 3
    nodes, edges, root = causation.build_graph(log, "saga")
    assert root == "e0" and edges.count() == 3
    assert causation.build_graph(log, "none") is None
    text = causation.to_dot(nodes, edges)
    assert '  e1 -> e2;' in text and text.startswith("digraph causation {\n") and text.endswith("}\n")
    assert causation.to_dot(nodes.limit(0), edges.limit(0)) == "digraph causation {\n}\n"


def test_canonical_log_keeps_the_earliest_delivery(spark):
    d = log_of(spark, [{"event_id": "a", "epoch_us": 5, "data": "late"}, {"event_id": "a", "epoch_us": 3, "data": "first"}, {"event_id": "a", "epoch_us": 3, "data": "tie"}, {"event_id": None}]).withColumn("delivery_id", F.monotonically_increasing_id())
    assert [r.data for r in canonical(d).collect()] == ["first"]


def test_snapshots(spark):
    rows = [("s", 1, "a", None, 1), ("s", 1, "b", None, 2), ("s", 3, None, {}, 3), ("t", 0, "z", {"k": "v"}, 1)]
    s = spark.createDataFrame(rows, "stream_id string, version long, data string, metadata map<string,string>, timestamp_ms long")
    assert {(r.stream_id, r.version): r.data for r in snapshots.current(s).collect()} == {("s", 1): "b", ("s", 3): None, ("t", 0): "z"}
    assert snapshots.load(s, "s").first().version == 3
    assert snapshots.load_at(s, "s", 2).count() == 0 and snapshots.load_at(s, "s", 1).first().data == "b"
    assert [r.version for r in snapshots.list_snapshots(s, "s", True).collect()] == [3, 1]
    assert snapshots.exists(s, "s", 3) and not snapshots.exists(s, "s", 2) and not snapshots.exists(s, "q")
    assert snapshots.delete(s, "s").count() == 1 and snapshots.delete(s, "s", 3).count() == 3
    assert snapshots.save(s, s.where("stream_id = 't'").withColumn("timestamp_ms", F.lit(9)).withColumn("data", F.lit("new"))).where("stream_id = 't'").first().data == "new"


def test_scavenge_and_archive(spark, five):
    saved = spark.createDataFrame([("s",)], "stream_id string")
    none = saved.limit(0)
    plan = lambda snaps, **o: retention.plan(five, snaps, retention.Scavenge(**o)).first()
    assert tuple(plan(saved, before_version=3))[1:] == ("ok", 3, 0, 2)
    assert tuple(plan(saved, before=3_000_000))[1:] == ("ok", 3, 0, 2)
    assert tuple(plan(saved, before=3_000_000, exclusive=True))[1:] == ("ok", 2, 0, 1)
    assert tuple(plan(saved, before_version=5, keep=3))[1:] == ("ok", 2, 0, 1)
    assert plan(none, before_version=3).status == "no_snapshot" and plan(none, before_version=3).deleted_count == 0
    assert plan(none, before_version=3, require_snapshot=False).deleted_count == 3
    assert plan(saved).deleted_count == 0
    backend = archive.FolderArchive(spark, Scratch(spark, "t").path("archive"))
    kept, report = retention.archive_and_scavenge(five, saved, "s", retention.Scavenge(before_version=2), backend, "main", dry_run=True)
    assert kept.count() == 5 and not report["archived"] and backend.list("main", "s") == []
    kept, report = retention.archive_and_scavenge(five, saved, "s", retention.Scavenge(before_version=2), backend, "main")
    assert versions(kept.orderBy("version")) == [2, 3, 4] and report["archive_key"] == "main/s/0-1.archive"
    assert versions(backend.read("main/s/0-1.archive")) == [0, 1] and backend.exists("main/s/0-1.archive") and backend.list("main", "s") == ["main/s/0-1.archive"]
    backend.delete("main/s/0-1.archive")
    backend.delete("main/s/0-1.archive")
    with pytest.raises(archive.ArchiveNotFound):
        backend.read("main/s/0-1.archive")
    assert retention.archive_and_scavenge(five, saved, "zz", retention.Scavenge(), backend, "main")[1]["status"] == "stream_not_found"
    assert archive.parse_key("my_store/orders-123/0-99.archive") == ("my_store", "orders-123", 0, 99)
    for bad in ("a/b/c/0-1.archive", "a/0-1.archive", "a/b/0-1", "a/b/x-1.archive"):
        with pytest.raises(ValueError):
            archive.parse_key(bad)


def test_upcast_and_validate(spark):
    r = schema_registry.SchemaRegistry()
    r.register("T", schema_registry.EventSchema(4, {1: schema_registry.add_field("currency", '"EUR"'), 2: schema_registry.rename_field("user_name", "username")}, lambda d: F.get_json_object(d, "$.amount").isNotNull()))
    with pytest.raises(ValueError):
        r.register("T", schema_registry.EventSchema(0))
    log = log_of(spark, [{"data": {"user_name": "u", "amount": 1, "z": [1]}}, {"data": {"user_name": "u"}, "metadata": {"schema_version": "2", "k": "v"}}, {"data": {"user_name": "u"}, "metadata": {"schema_version": "4"}}, {"event_type": "other"}, {"data": "no json"}, {"data": None}])
    got = r.validated(r.upcast(log)).orderBy("version").collect()
    assert json.loads(got[0].data) == {"amount": 1, "currency": "EUR", "username": "u", "z": [1]} and got[0].metadata == {"schema_version": "3"} and got[0].valid
    assert json.loads(got[1].data) == {"username": "u"} and got[1].metadata == {"schema_version": "3", "k": "v"} and not got[1].valid
    assert json.loads(got[2].data) == {"user_name": "u"} and got[3].valid and got[3].metadata is None
    assert got[4].data == "no json" and got[5].data is None
    nested = schema_registry.nest_fields(["street", "city"], "address")
    assert json.loads(spark.range(1).select(nested(F.lit('{"street":"a","city":"b","n":1}')).alias("d")).first().d) == {"address": {"street": "a", "city": "b"}, "n": 1}
    r.unregister("T")
    assert r.list() == []


def test_links(spark):
    rows = [{"stream_id": s, "version": v, "event_id": f"{s}{v}", "data": {"amount": a}, "metadata": {"p": "1", "source_stream": "old"}, "tags": ["t"]} for s, v, a in (("b", 0, 50), ("a", 1, 150), ("a", 0, 100), ("$link:x", 0, 999))]
    log = log_of(spark, rows)
    link = links.Link("high", links.Source("all"), lambda df: F.get_json_object("data", "$.amount").cast("int") >= 100, lambda df: {"event_type": F.lit("High")})
    got = links.copies(log, link, 5).orderBy("version").collect()
    assert [(r.stream_id, r.version, r.event_id, r.event_type, r.tags) for r in got] == [("$link:high", 5, "a0", "High", ["t"]), ("$link:high", 6, "a1", "High", ["t"])]
    assert got[1].metadata == {"p": "1", "source_stream": "a", "source_version": "1"}
    assert links.copies(log.limit(0), link).count() == 0
    registry = links.LinkRegistry()
    registry.create(link, 7)
    registry.start("high")
    registry.processed("high", 2, "a1")
    assert registry.info("high", log)["status"] == "running" and registry.info("high", log)["version"] == -1 and registry.get("high").processed == 2
    registry.delete("high")
    with pytest.raises(KeyError):
        registry.get("high")
    with pytest.raises(ValueError):
        links.selected(log, links.Link("bad", links.Source("all"), transform=lambda df: {"version": F.lit(1)}))


def test_subscriptions(spark):
    log = log_of(spark, [{"event_type": "A", "data": {"status": "open", "n": 5}}, {"event_type": "B", "data": {"status": "done", "n": "5"}, "stream_id": "t-1"}, {"data": "x"}])
    ids = lambda kind, sel: [r.event_id for r in subscriptions.matching(log, kind, sel).orderBy("event_id").collect()]
    assert ids("stream", "$all") == ["e0", "e1", "e2"] and ids("stream", "t-1") == ["e1"] and ids("event_type", "A") == ["e0"]
    assert ids("event_pattern", "t-*") == ["e1"] and ids("event_pattern", {"event_type": "B", "version": 1}) == ["e1"]
    assert ids("event_payload", {"n": 5}) == ["e0"] and ids("event_payload", {"n": {"gt": 4}}) == ["e0"] and ids("event_payload", {"status": {"in": ["open", "x"]}}) == ["e0"] and ids("event_payload", {"status": {"ne": "open"}}) == ["e1", "e2"]
    with pytest.raises(ValueError):
        ids("nothing", "x")
    seen, reg = [], subscriptions.SubscriptionRegistry()
    reg.setup_tracking(lambda what, sub: seen.append(what))
    key = reg.subscribe("stream", "s", "one", start_from=3)
    with pytest.raises(subscriptions.AlreadyExists):
        reg.subscribe("stream", "s", "one")
    assert reg.ack("one", 9).checkpoint == 9 and reg.exists(key) and reg.table(spark).count() == 1
    reg.unsubscribe(kind="stream", name="one")
    with pytest.raises(LookupError):
        reg.unsubscribe(key)
    assert seen == ["created", "updated", "deleted"]


def test_store_appends(spark):
    path = Scratch(spark, "t").path("store")
    store = StoreCatalog(spark).start("main", path)
    ev = lambda n: [{"event_type": "T", "data": {"i": i}, "tags": ["x"]} for i in range(n)]
    assert store.append("s", NO_STREAM, ev(1)) == 0
    assert store.append("t", ANY_VERSION, ev(5)) == 4
    with pytest.raises(streams.WrongExpectedVersion) as e:
        store.append("s", 5, ev(1))
    assert (e.value.expected, e.value.current) == (5, 0)
    with pytest.raises(streams.WrongExpectedVersion):
        store.append("s", NO_STREAM, ev(1))
    assert store.append("s", 0, ev(2)) == 2 and store.append("s", ANY_VERSION, []) == 2
    assert store.append("u", 0, ev(1), gateway=True) == 0 and store.append("u", "stream_exists", ev(1), gateway=True) == 1
    log = store.log()
    assert versions(streams.read(log, "t", 0, 9)) == [0, 1, 2, 3, 4]
    assert [json.loads(r.data)["i"] for r in streams.read(log, "t", 0, 9).collect()] == [0, 1, 2, 3, 4]
    assert log.where("stream_id = 't'").select("epoch_us").distinct().count() == 1 and log.where("event_id is null").count() == 0
    store.delete("t")
    store.delete("nothing")
    assert not streams.exists(store.log(), "t") and store.append("t", NO_STREAM, ev(1)) == 5
    store.save_snapshot("s", 1, {"a": 1})
    store.save_snapshot("s", 1, {"a": 2})
    assert [r.data for r in Store(spark, path).snapshots().collect()] == ['{"a":2}']
    assert Store(spark, path).version("s") == 2


def test_store_numbers_the_rows_that_it_writes(spark):
    """A plan run a second time for fewer columns may have fewer, larger partitions; versions must be those of the rows written."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("id")).select("id", F.col("id").cast("string").alias("event_id"), F.lit("T").alias("event_type"), F.concat(*[F.sha2(F.concat("id", F.lit(f"/{i}")), 256) for i in range(4)]).alias("data")).orderBy("id")
        store = Store(spark, Scratch(spark, "t").path("store"))
        assert store.append("s", NO_STREAM, rows.where("id % 5 > 0").drop("id")) == 15999
        store.compact()
        assert store.version("s") == 15999 and store.append("s", 15999, rows.where("id % 5 = 0").drop("id")) == 19999
        got = [(r.version, int(r.event_id)) for r in store.log().select("version", "event_id").orderBy("version").collect()]
        assert got == list(enumerate([i for i in range(20000) if i % 5] + list(range(0, 20000, 5))))
        assert not any(n.startswith("staged") for n in list_names(spark, f"{store.path}/data"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_two_writers_never_share_a_version(spark, monkeypatch):
    path = Scratch(spark, "t").path("store")
    a, b = Store(spark, path), Store(spark, path)
    ev = [{"event_type": "T", "data": "{}"}]
    plain = a._numbered

    def meanwhile(*args):
        monkeypatch.setattr(a, "_numbered", plain)
        b.append("s", ANY_VERSION, ev)
        return plain(*args)

    monkeypatch.setattr(a, "_numbered", meanwhile)
    assert a.append("s", ANY_VERSION, ev) == 1
    monkeypatch.setattr(a, "_numbered", meanwhile)
    with pytest.raises(streams.WrongExpectedVersion):
        a.append("s", 1, ev)
    assert versions(streams.read(a.log(), "s", 0, 9)) == [0, 1, 2]
    monkeypatch.setattr(a, "_commit", lambda *x: False)
    with pytest.raises(Conflict):
        a.append("s", ANY_VERSION, ev)


def test_plan_of_upcasts_grows_with_the_steps(spark):
    def size(n):
        r = schema_registry.SchemaRegistry()
        for i in range(n):
            steps = {1: schema_registry.add_field(f"f{i}", str(i)), 2: schema_registry.rename_field(f"f{i}", f"g{i}"), 3: lambda d: F.upper(d), 4: schema_registry.nest_fields(["A"], f"in{i}")}
            r.register(f"T{i}", schema_registry.EventSchema(5, steps))
        up = r.upcast(log_of(spark, [{"event_type": "T1", "data": {"a": 1}}, {"event_type": "T0", "data": {"a": 2}, "metadata": {"schema_version": "3"}}]))
        assert [json.loads(x.data) for x in up.orderBy("version").collect()] == [{"G1": 1, "in1": {"A": 1}}, {"in0": {"A": 2}}]
        return len(up._jdf.queryExecution().analyzed().toString())

    assert size(24) < 3 * size(12)
