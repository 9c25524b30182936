import pytest

from strandlog.gateway import Gateway, StoreRegistry
from strandlog.operators.schema_registry import EventSchema, add_field
from strandlog.operators.streams import StreamNotFound, WrongExpectedVersion
from strandlog.runtime import Scratch
from tests.test_event_store import folded


def test_a_store_through_the_gateway(spark):
    g = Gateway(spark)
    g.open("main", Scratch(spark, "t").path("main"))
    ev = lambda n, c=None: [{"event_type": "T", "data": {"n": {"sum": n}}, "tags": ["x"], "event_id": f"e{n}", "metadata": {"causation_id": c} if c else {}}]
    assert g.append_events("main", "s", ev(1)) == 0 and g.append_events("main", "s", ev(2, "e1"), 0) == 1
    with pytest.raises(WrongExpectedVersion):
        g.append_events("main", "s", ev(3), 5)
    assert [r.version for r in g.stream_backward("main", "s", 1, 5).collect()] == [1, 0] and g.get_version("main", "s") == 1
    with pytest.raises(StreamNotFound):
        g.stream_forward("main", "none", 0, 1)
    assert [r.event_id for r in g.get_effects("main", "e1").collect()] == ["e2"] and g.get_cause("main", "e2")[0] == "found"
    assert [r.event_id for r in g.get_chain("main", "e2").collect()] == ["e1", "e2"]
    assert g.read_by_tags("main", ["x"]).count() == 2 and g.read_by_event_types("main", ["U"]).count() == 0
    g.record_snapshot("main", "s", 0, {"n": 100})
    assert folded(g.state("main", "s")) == {("s", "n"): 102} and g.list_snapshots("main", "s").count() == 1 and g.read_snapshot("main", "s", 7).count() == 0
    g.schemas("main").register("T", EventSchema(2, {1: add_field("k", "1")}))
    assert g.upcast_events("main", g.get_events("main", "s", 0, 1)).first().metadata["schema_version"] == "2"
    assert g.get_memory_stats()["level"] == g.get_memory_level() and g.list_stores() == ["main"]
    g.delete_stream("main", "s")
    assert not g.stream_exists("main", "s") and g.get_streams("main").count() == 0
    g.close("main")
    assert g.list_stores() == [] and g.registry.stores() == []


def test_registry():
    r = StoreRegistry()
    r.announce("a", "s1")
    r.announce("b", "s1", {"k": 1})
    r.announce("b", "s2")
    assert r.stores() == ["s1", "s2"] and r.on_node("b") == ["s1", "s2"] and r.about("s1") == {"a": {}, "b": {"k": 1}}
    r.node_left("b")
    assert r.stores() == ["s1"]
