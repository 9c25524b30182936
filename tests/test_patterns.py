import random
from fractions import Fraction
from itertools import combinations

import pytest

from strandlog.operators import patterns as p

SCHEMA = "s string, v long, t string, id string, seq string, code int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def brute(rows, share, shortest, longest):
    seqs, items = {s for s, *_ in rows if s is not None}, {}
    for s, v, t, i in rows:
        if None not in (s, v, t, i):
            items.setdefault(s, set()).add((v, i, t))
    count = {}
    for s, x in items.items():
        codes = [t for _, _, t in sorted(x)]
        for sub in {c for n in range(shortest, longest + 1) for c in combinations(codes, n)}:
            count[sub] = count.get(sub, 0) + 1
    return {k: n for k, n in count.items() if n >= share * len(seqs)}


def run(spark, rows, share=Fraction(1, 4), shortest=2, longest=4, block=p.BLOCK):
    f = p.frequent_patterns(frame(spark, rows), "s", "v", "t", "id", share, shortest, longest, block)
    return {tuple(r["items"]): r.support for r in f.collect()}


def random_rows(seed, streams=14, long=9):
    rng = random.Random(seed)
    rows = []
    for s in range(streams):
        for v in range(rng.randrange(long)):
            rows += [(f"s{s}", v, rng.choice(["A", "B", "C", None]), f"{s}-{v}")] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [2, p.BLOCK])
def test_equals_brute_force(spark, seed, block):
    rows = random_rows(seed)
    rows += [(None, 1, "A", "x"), ("only-null", 1, None, "y"), ("s0", None, "A", "z"), ("s0", 99, "A", None)]
    assert run(spark, rows, block=block) == brute(rows, Fraction(1, 4), 2, 4)


def test_long_sequence_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "FAN", 3)
    rng = random.Random(1)
    rows = [("hot", v, "ABCD"[min(3, int(rng.expovariate(0.9)))], f"h{v}") for v in range(400)] + random_rows(2, 4)
    short = [r for r in rows if r[0] != "hot"] + [("hot", v, t, i) for s, v, t, i in rows if s == "hot"]
    got = run(spark, short, Fraction(1, 5), 1, 3, block=4)
    assert got == brute(short, Fraction(1, 5), 1, 3)


def test_reduction_keeps_all_short_patterns():
    rng = random.Random(3)
    for _ in range(60):
        seq = [rng.randrange(3) for _ in range(rng.randrange(18))]
        keep = p._useful(3, 3)
        kept = [c for c in seq if keep(c)]
        subs = lambda x: {c for n in range(1, 4) for c in combinations(x, n)}
        assert subs(seq) == subs(kept)


def test_empty_and_none_frequent(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", 0, "X", "1"), ("b", 0, "Y", "2"), ("c", 0, None, "3")], Fraction(1, 2)) == {}


@pytest.mark.parametrize("block", [2, p.BLOCK])
def test_equal_order_and_item_under_two_ids_are_two_items(spark, block):
    rows = [("a", 1, "X", "i"), ("a", 1, "X", "j"), ("b", 5, "X", "k"), ("b", 5, "X", "l"), ("b", 5, "X", "l")]
    assert run(spark, rows, Fraction(1), block=block) == {("X", "X"): 2}


@pytest.mark.parametrize("seed", range(2))
def test_ties_are_ordered_by_id_in_all_reductions(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{s}", rng.choice([0, 1, 40, 41, 90]), rng.choice("ABC"), f"{s}-{rng.randrange(10**6)}") for s in range(10) for _ in range(8)]
    rng.shuffle(rows)
    assert run(spark, rows, Fraction(1, 2), block=2) == brute(rows, Fraction(1, 2), 2, 4)
