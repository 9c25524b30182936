import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators.increments import IntervalLedger, disjoint_intervals, pending
from strandlog.runtime import Scratch

EVENTS, CLAIMS = "stream string, number long, arrived long, kind string, block string", "stream string, first long, last long, seen long, low string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], EVENTS)


def claims(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], CLAIMS)


def brute(ev, cl):
    first = {}
    for s, n, a in ev:
        if s is not None and n is not None:
            old = first.get((s, n))
            first[s, n] = a if old is None else old if a is None else min(a, old)
    done = lambda s, n, a: a is not None and any(cs == s and None not in (f, t, r) and f <= n <= t and r >= a for cs, f, t, r in cl)
    return {(s, n) for (s, n), a in first.items() if not done(s, n, a)}


def some(seed):
    rng = random.Random(seed)
    ev = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(60), rng.choice([*range(6), None])) for _ in range(300)] + [(None, 1, 1), ("a", None, 1)]
    cl = [(rng.choice(["hot", "a", "c"]), f, f + rng.choice([0, 3, 20, -2, 10**15]), rng.randrange(6)) for f in (rng.randrange(-5, 60) for _ in range(25))]
    return ev, cl + cl[:4] + [(None, 0, 5, 9), ("a", None, 9, 9), ("a", 1, None, 9), ("a", 1, 9, None)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [7, 4096])
def test_pending_equals_brute_force(spark, seed, block):
    ev, cl = some(seed)
    got = [tuple(r) for r in pending(events(spark, ev), claims(spark, cl), block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ev, cl)


@pytest.mark.parametrize("block", [5, 4096])
def test_disjoint_intervals_cover_the_same(spark, block):
    _, cl = some(4)
    bounds = spark.createDataFrame([("hot", 0, 70), ("a", 3, 40)], "stream string, low long, high long")
    got = sorted(tuple(r) for r in disjoint_intervals(claims(spark, cl), bounds, block).collect())
    cover = {}
    for s, a, z, r in got:
        for n in range(a, z + 1):
            assert (s, n) not in cover
            cover[s, n] = r
    want = {}
    for s, low, high in (("hot", 0, 70), ("a", 3, 40)):
        for n in range(low, high + 1):
            hit = [r for cs, f, t, r in cl if cs == s and None not in (f, t, r) and f <= n <= t]
            if hit:
                want[s, n] = max(hit)
    assert cover == want
    assert all(not (x[0] == y[0] and x[2] + 1 == y[1] and x[3] == y[3]) for x, y in zip(got, got[1:])), "neighbours are joined"


def test_pending_needs_no_python(spark):
    plan = pending(events(spark, [("a", 1, 1)]), claims(spark, [("a", 0, 9, 9)]))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Window" in plan


def test_ledger_repeats_nothing_after_a_run_that_sees_less(spark):
    ledger = IntervalLedger(spark, Scratch(spark, "t").path("ledger"))
    log = events(spark, [("a", n, n) for n in range(10)])
    for seen in (9, 3, 9):
        ledger.run(log, lambda df: df.select("stream", "number").distinct(), seen)
    assert sorted(r.number for r in ledger.output().collect()) == list(range(10))


def test_empty(spark):
    assert pending(events(spark, []), claims(spark, [])).count() == 0
    assert pending(events(spark, [("a", 1, 1)]), claims(spark, [])).count() == 1


def test_ledger_takes_late_events_once_and_survives_failure(spark):
    ledger = IntervalLedger(spark, Scratch(spark, "t").path("ledger"), block=4)
    log = [("a", n, 0) for n in range(5)] + [("b", 0, 0), ("a", 2, 1)]
    late = [("a", 7, 1), ("b", 1, 2), ("a", 5, 2), ("a", 6, 9)]
    out = lambda df: df.select("stream", "number").distinct()

    def fail(_):
        raise OSError("lost an executor")

    with pytest.raises(OSError):
        ledger.run(events(spark, log), fail, seen=1)
    ledger.run(events(spark, log), out, seen=1)
    ledger.run(events(spark, log + late), out, seen=2)
    ledger.run(events(spark, log + late), out, seen=2)
    got = sorted(tuple(r) for r in ledger.output().collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("a", 7), ("b", 0), ("b", 1)]
    assert {(r.stream, r.first, r.last) for r in ledger.intervals().collect()} == {("a", 0, 5), ("a", 7, 7), ("b", 0, 1)}
    ledger.run(events(spark, log + late).where(F.lit(True)), out, seen=9)
    assert ledger.output().where("number = 6").count() == 1


def test_ledger_takes_null_arrivals_once_and_keeps_what_earlier_runs_saw(spark):
    ledger = IntervalLedger(spark, Scratch(spark, "t").path("ledger"), block=4)
    log = [("a", 0, None), ("a", 1, 5), ("a", 2, 1), ("a", 2, None), ("b", 0, None)]
    out = lambda df: df.select("stream", "number").distinct()
    for seen in (5, 2, 7):  # the second run sees less than the first
        ledger.run(events(spark, log), out, seen)
        assert {r.seen for r in ledger.intervals().collect()} == {max(5, seen)}
    ledger.run(events(spark, [*log, ("a", 3, None)]), out, 1)
    assert sorted(tuple(r) for r in ledger.output().collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
