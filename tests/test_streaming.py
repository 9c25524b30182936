import json

import pytest
from pyspark.sql import functions as F

from strandlog.operators import links
from strandlog.runtime import Scratch
from strandlog.streaming import live
from strandlog.streaming.telemetry import Telemetry
from tests.test_event_store import folded, log_of, sequential


@pytest.fixture()
def folder(spark):
    scratch = Scratch(spark, "stream")
    rows = [{"stream_id": s, "version": v, "event_id": f"{s}{v}", "event_type": "A" if v % 2 else "B", "data": {"n": {"sum": v}, "k": v}} for s in ("x", "y") for v in range(4)]
    log_of(spark, rows[:5]).coalesce(1).write.mode("append").parquet(scratch.path("in"))
    return scratch, rows


def more(spark, scratch, rows):
    log_of(spark, rows).coalesce(1).write.mode("append").parquet(scratch.path("in"))


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_delivery_goes_on_where_it_stopped(spark, folder):
    scratch, rows = folder
    got = []
    start = lambda: live.deliver(live.log_stream(spark, scratch.path("in")), "event_type", "A", lambda df, n: got.extend(r.event_id for r in df.collect()), "sub", scratch.path("cp"), 1, True)
    run(start())
    assert sorted(got) == ["x1", "x3"]
    more(spark, scratch, rows[5:])
    run(start())
    assert sorted(got) == ["x1", "x3", "y1", "y3"]


def test_live_link_numbers_go_on(spark, folder):
    scratch, rows = folder
    link = links.Link("k", links.Source("all"), lambda df: F.col("event_type") == "A")
    registry = links.LinkRegistry()
    registry.create(link, 1)
    go = lambda: run(live.run_link(live.log_stream(spark, scratch.path("in")), link, scratch.path("out"), scratch.path("cp"), registry, True))
    go()
    more(spark, scratch, rows[5:])
    go()
    out = spark.read.parquet(scratch.path("out")).orderBy("version").collect()
    assert [(r.version, r.event_id) for r in out] == [(0, "x1"), (1, "x3"), (2, "y1"), (3, "y3")] and registry.get("k").processed == 4


def test_running_fold_ends_in_the_same_state(spark, folder):
    scratch, rows = folder
    more(spark, scratch, rows[5:])
    last = {}

    def keep(df, n):
        for r in df.collect():
            last[r.group, r.field] = r.number

    q = live.running_fold(live.log_stream(spark, scratch.path("in"), max_files=1)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch.path("cp")).trigger(availableNow=True).start()
    run(q)
    for s in ("x", "y"):
        want = sequential([r["data"] for r in rows if r["stream_id"] == s])
        assert {k: last[s, k] for k in want} == want


def test_totals_and_windows(spark, folder):
    scratch, rows = folder
    stream = live.log_stream(spark, scratch.path("in"))
    q = live.running_totals(stream, "n").writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", scratch.path("a")).trigger(availableNow=True).start()
    run(q)
    assert {r.stream_id: (r.events, r.last_version) for r in spark.table("totals").collect()} == {"x": (4, 3), "y": (1, 0)}
    q = live.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", scratch.path("b")).trigger(availableNow=True).start()
    run(q)
    assert spark.table("windows").count() == 0  # nothing is closed while the watermark is a day behind


def test_telemetry():
    t, seen = Telemetry(), []
    t.attach("a", [("x", "stop")], lambda e, m, meta: seen.append((e, sorted(m), meta)))
    t.attach("bad", None, lambda e, m, meta: 1 / 0)
    with t.span(("x",), {"k": 1}):
        pass
    assert seen == [(("x", "stop"), ["duration_ns"], {"k": 1})]
    with pytest.raises(ValueError):
        t.attach("a", None, print)
    with pytest.raises(KeyError), t.span(("x",)):
        raise KeyError
    assert json.dumps(seen) and folded


def test_runner_keeps_definitions_and_goes_on_under_a_new_driver(spark, folder):
    from strandlog.operators import links

    scratch, rows = folder
    home, got = scratch.path("home"), []
    a = live.Runner(spark, scratch.path("in"), home)
    a.links.create(links.Link("all", links.Source("all"), lambda df: F.col("event_type").isNotNull(), backfill=True), 0)
    run(a.start_link("all", available_now=True))
    key = a.subscribe("stream", "x", "s", lambda df, n: got.extend(r.version for r in df.collect()), available_now=True)
    run(a.queries[f"subscription {key}"])
    a.close()
    more(spark, scratch, rows[5:])
    b = live.Runner(spark, scratch.path("in"), home)
    assert [(x.name, x.status) for x in b.links.list()] == [("all", "running")] and b.subscriptions.exists(key)
    run(b.start_link("all", available_now=True))
    run(b.start_subscription(key, lambda df, n: got.extend(r.version for r in df.collect()), available_now=True))
    made = spark.read.parquet(b.link_path("all"))
    assert sorted(r.version for r in made.collect()) == list(range(len(rows))) and b.links.get("all").processed == len(rows)
    assert sorted(got) == sorted(r["version"] for r in rows if r["stream_id"] == "x")
    b.delete_link("all")
    b.unsubscribe(key)
    c = live.Runner(spark, scratch.path("in"), home)
    assert not c.links.list() and not c.subscriptions.list() and not b.queries
