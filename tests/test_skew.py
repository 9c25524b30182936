from collections import defaultdict

import pytest

from strandlog.operators import skew
from strandlog.operators.skew import Measure, keys_with_share, salted_aggregate
from strandlog.runtime import heavy_keys, salt_for

MEASURES = [Measure("rows", "count"), Measure("ids", "count_distinct", "id"), Measure("top", "max", "v"), Measure("low", "min", "v"), Measure("total", "sum", "v"), Measure("first", "min_by", "id", "v"), Measure("last", "max_by", "id", "v")]


def make(spark, rows):
    return spark.createDataFrame([(k, i, v, "x") for k, i, v in rows], "k string, id string, v long, __salt string")


def brute(rows):
    groups = defaultdict(list)
    for k, i, v in rows:
        groups[k].append((i, v))
    out = {}
    for k, g in groups.items():
        known = [(v, i) for i, v in g if v is not None]
        vs = [v for v, _ in known]
        out[k] = (len(g), len({i for i, _ in g if i is not None}), max(vs, default=None), min(vs, default=None), sum(vs) if vs else None, min(known, key=lambda t: (t[0], t[1]))[1] if known else None, max(known, key=lambda t: (t[0], t[1]))[1] if known else None)
    return out


@pytest.mark.parametrize("share", [0.01, 0.2, 1.0])
def test_equals_brute_force_with_hot_key_nulls_ties_and_copies(spark, share):
    rows = [("hot", f"e{i % 70}", i % 13) for i in range(300)] + [("hot", "copy", 5)] * 200 + [(f"k{i % 9}", f"e{i}", i) for i in range(40)] + [(None, "n", 1), (None, None, None), ("", "e", 2), ("nulls", "a", None)]
    rows = [(k, i if i is not None else None, v) for k, i, v in rows]
    # ids are text and ordered, so ties in v are decided by id
    got = {r.k: tuple(r)[1:] for r in salted_aggregate(make(spark, rows), ["k"], MEASURES, share, 8).frame.collect()}
    want = brute([(k, i, v) for k, i, v in rows])
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k


def test_without_distinct_and_empty(spark):
    plain = [m for m in MEASURES if m.kind != "count_distinct"]
    rows = [("a", "x", 1)] * 5 + [("b", "y", 2)]
    assert {r.k: r.rows for r in salted_aggregate(make(spark, rows), ["k"], plain, 0.5).frame.collect()} == {"a": 5, "b": 1}
    empty = make(spark, rows).limit(0)
    assert salted_aggregate(empty, ["k"], MEASURES).frame.count() == 0
    assert keys_with_share(empty, "k", 0.02).count() == 0


def test_keys_with_share_takes_the_exact_limit(spark):
    rows = [("a", str(i), i) for i in range(2)] + [(f"k{i}", str(i), i) for i in range(98)]
    assert [r.k for r in keys_with_share(make(spark, rows), "k", 0.02).collect()] == ["a"]
    with_null = [(None, "x", 1)] * 50 + rows[:50]
    assert {r.k for r in keys_with_share(make(spark, with_null), "k", 0.02).collect()} == {"a"}


def test_keys_with_share_compares_whole_numbers(spark):
    rows = spark.range(100).selectExpr("if(id < 7, 'a', concat('k', id)) AS k", "id")  # 0.07 * 100 is above 7 in doubles
    assert [r.k for r in keys_with_share(rows, "k", 0.07, spread=["id"]).collect()] == ["a"]


def test_heavy_keys_names_every_key_at_the_limit_and_few_others(spark):
    rows = spark.range(200_000).selectExpr("CASE WHEN id < 1000 THEN 'edge' WHEN id < 60000 THEN 'hot' WHEN id < 62000 THEN null ELSE cast(id AS string) END AS k")
    total, heavy = heavy_keys(rows, ["k"], 0.005)
    want = {r.h for r in rows.where("k IN ('edge', 'hot') OR k IS NULL").select(skew.key_hash("k").alias("h")).distinct().collect()}
    assert total == 200_000 and want <= set(heavy) and len(heavy) <= 5
    assert heavy_keys(rows.limit(0), ["k"], 0.005) == (0, [])


def test_wrong_use(spark):
    with pytest.raises(ValueError):
        salted_aggregate(make(spark, []), ["k"], [Measure("a", "count_distinct", "id"), Measure("b", "count_distinct", "v")])


@pytest.mark.parametrize("spread", [None, ["id"]])
def test_a_heavy_key_gets_more_than_one_salt_without_measured_columns(spark, monkeypatch, spread):
    drawn = []
    monkeypatch.setattr(skew, "salt_for", lambda heavy, hashed, by, salts: drawn.append((heavy, by)) or salt_for(heavy, hashed, by, salts))
    rows = make(spark, [("hot", str(i), i) for i in range(200)] + [("k", "x", 1)]).selectExpr("*", "map('a', id) AS m")
    assert {(r.k, r.n_rows) for r in keys_with_share(rows, "k", 0.5, 0.5, 8, spread=spread).collect()} == {("hot", 200)}
    heavy, by = drawn[0]
    assert rows.where("k = 'hot'").select(salt_for(heavy, skew.key_hash("k"), by, 8).alias("salt")).distinct().count() == 8
