from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strandlog.operators.features import column_suffixes, entity_features, event_types

SCHEMA = "s string, t string, at long, id string, ord long, x string, __e string, n long, total string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def brute(rows):
    events = {}
    for s, t, at, i, o, x in rows:
        if i is not None and (i not in events or (at, o) < events[i][0]):
            events[i] = ((at, o), s, t, at, None if x is None else Decimal(x))
    out = defaultdict(lambda: defaultdict(lambda: [0, None, None]))
    for _, s, t, at, x in events.values():
        c = out[s][t]
        c[0] += 1
        c[1] = at if c[1] is None else max(c[1], at)
        c[2] = c[2] if x is None else x + (c[2] or 0)
    return out


def rows_with_hot_entity():
    rows = [("hot", f"T{i % 3}", i, f"h{i % 80}", i, str(i % 7)) for i in range(200)]
    rows = [(s, f"T{int(i[1:]) % 3}", at, i, o, x) for s, _, at, i, o, x in rows]  # an event has one type
    rows += [("hot", "copy", 9, "same", o, "1.5") for o in range(60)]
    rows += [("a", "T1", 5, "a1", 1, None), ("a", None, 6, "a2", 2, "2"), (None, "T1", 1, "z", 1, "3"), ("a", "T1", 1, None, 1, "9"), ("b", "t1", 3, "b1", 1, "-1.25"), ("b", "t1", 3, "b1", 2, "4")]
    return rows


@pytest.mark.parametrize("share", [0.2, 1.0])
@pytest.mark.parametrize("layout", ["wide", "map"])
def test_equals_brute_force(spark, share, layout):
    rows = rows_with_hot_entity()
    f = entity_features(frame(spark, rows), "s", "t", "at", "id", "ord", F.col("x").try_cast("decimal(28,6)"), layout, heavy_share=share, salts=4)
    want = brute(rows)
    got = {r.s: r for r in f.collect()}
    assert got.keys() == want.keys()
    types = sorted({t for c in want.values() for t in c if t is not None})
    names = dict(zip(types, column_suffixes(types)))
    for s, cells in want.items():
        r = got[s]
        assert r.n_events == sum(c[0] for c in cells.values())
        assert r.n_untyped == cells.get(None, [0])[0]
        assert r.last_time == max(c[1] for c in cells.values())
        for t in types:
            n, last, total = cells.get(t, (0, None, None))
            if layout == "wide":
                assert (r[f"n:{names[t]}"], r[f"last:{names[t]}"], r[f"total:{names[t]}"]) == (n, last, total), (s, t)
            elif n:
                c = r.features[t]
                assert (c.n, c.last_time, c.total) == (n, last, total)


def test_names_that_differ_by_case_and_too_many_types(spark):
    assert column_suffixes(["A", "a", "B"]) == ["A", "a#1", "B"]
    df = frame(spark, [("s", f"t{i}", 1, f"e{i}", 1, "1") for i in range(5)])
    assert event_types(df, "t", 5) == [f"t{i}" for i in range(5)]
    with pytest.raises(ValueError):
        event_types(df, "t", 4)


def test_empty(spark):
    assert entity_features(frame(spark, []), "s", "t", "at", "id", "ord", F.col("x").try_cast("decimal(28,6)")).count() == 0
