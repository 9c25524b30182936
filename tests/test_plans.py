"""What the plans of queries must and must not hold."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, pushed", [("stream_read_forward", "EqualTo(stream_id,hub-intake)"), ("read_by_event_types", "In(event_type"), ("subscription_by_stream", "EqualTo(stream_id,hub-intake)"), ("effects_of_one", "EqualTo(causation_id")])
def test_conditions_and_columns_reach_the_scan(spark, name, pushed):
    text = plan(spark, name)
    assert pushed in text
    schema = [x for x in text.splitlines() if "ReadSchema" in x]
    assert schema and all("metadata" not in x.split("ReadSchema")[1] and "data:" not in x.split("ReadSchema")[1] for x in schema)


@pytest.mark.parametrize("name", ["p1_stream_totals", "p3_cells", "stream_versions", "temporal_versions_at", "fold_forward", "sum_field", "schema_upcast", "scavenge_before_time", "subscription_counts", "text_matches", "hash_fnv1a"])
def test_no_python_and_no_product_of_tables(spark, name):
    text = plan(spark, name)
    assert not any(x in text for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p6_found", "event_causes", "correlation_graphs", "log_after_scavenge", "schema_states", "link_copies", "probe_states", "temporal_versions_as_of"])
def test_no_product_of_tables(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_top_n_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "read_by_event_types_first")
