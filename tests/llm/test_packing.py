import random
from collections import defaultdict

import pytest

from strandlog.llm import packing as p
from strandlog.llm import tokenizer as t

TIERS = (8, 32, 128)


def place(plan):
    """Window -> [(offset, length, slot)] of every item the plan holds."""
    windows, seen = defaultdict(list), defaultdict(set)
    for n, a, z, w, off, slot in zip(plan.length, plan.rank_from, plan.rank_to, plan.window_from, plan.offset, plan.slot):
        for k in range(a, z):
            assert k not in seen[n]
            seen[n].add(k)
            windows[w + k - a].append((off, n, slot))
    return windows, {n: len(s) for n, s in seen.items()}


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once_without_overlap(seed):
    rng = random.Random(seed)
    hist = {n: rng.randrange(1, 60) for n in rng.sample(range(1, 129), rng.randrange(1, 90))}
    plan = p.plan_windows(hist, TIERS)
    windows, placed = place(plan)
    assert placed == hist
    capacity = {w: tier for tier, first, count in plan.tiers for w in range(first, first + count)}
    assert windows.keys() == capacity.keys()
    for w, items in windows.items():
        items.sort()
        end = 0
        for k, (off, n, slot) in enumerate(items):
            assert off == end and slot == k
            end = off + n
        assert end <= capacity[w]
        assert max(n for _, n, _ in items) <= capacity[w]


def test_fill_is_close_to_full_and_gaps_take_shorter_items():
    rng = random.Random(1)
    hist = defaultdict(int)
    for _ in range(20000):
        hist[min(128, int(rng.lognormvariate(2.5, 1)) + 1)] += 1
    plan = p.plan_windows(dict(hist), TIERS)
    room = sum(tier * count for tier, _, count in plan.tiers)
    assert sum(n * c for n, c in hist.items()) / room > 0.985
    long = range(plan.tiers[0][1], plan.tiers[0][1] + plan.tiers[0][2])
    assert any(n <= 8 and w in long for n, w in zip(plan.length, plan.window_from))
    assert len(plan.length) < 20 * 128


def test_limits():
    with pytest.raises(ValueError):
        p.plan_windows({129: 1}, TIERS)
    assert p.plan_windows({}, TIERS).length == []


def docs(spark, texts):
    return spark.createDataFrame([(i, x, "clash", 5) for i, x in texts], "doc_id long, text string, piece string, n_tokens int")


def check(rows, texts):
    enc = t.encoder(t.vocabulary_bytes())
    sizes = [len(enc.encode_ordinary(x)) if x else 0 for _, x in texts]
    assert sum(r.n_tokens for r in rows) == sum(sizes)
    by_window = defaultdict(list)
    for r in rows:
        if r.n_tokens == 0:
            assert r.window_id is None and r.step_group is None
        else:
            by_window[r.window_id].append(r)
    for rs in by_window.values():
        rs.sort(key=lambda r: r.window_offset)
        assert len({(r.window_tokens, r.step_group) for r in rs}) == 1
        end = 0
        for r in rs:
            assert r.window_offset == end
            end += r.n_tokens
        assert end <= rs[0].window_tokens
    return by_window


def test_documents_are_whole_unless_too_long(spark):
    rng = random.Random(2)
    texts = [(i, "word " * rng.choice([1, 2, 3, 7, 7, 7, 20, 60, 126, 127, 128, 129, 300, 513])) for i in range(150)] + [(900, None), (901, ""), (None, "null id"), (7, "again"), (7, "again")]
    rows = p.pack_documents(docs(spark, texts), "doc_id", "text", TIERS, 2).collect()
    windows = check(rows, texts)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, x in texts[:150]:
        if i == 7:
            continue
        n = sum(r.n_tokens for r in pieces[i])
        rs = sorted(pieces[i], key=lambda r: r.piece)
        assert len(rs) == max(1, -(-n // 128))
        assert [r.first_token for r in rs] == [128 * k for k in range(len(rs))]
    groups = defaultdict(set)
    for w, rs in windows.items():
        groups[rs[0].window_tokens, rs[0].step_group].add(w)
    for tier in TIERS:
        sizes = [len(v) for (k, _), v in groups.items() if k == tier]
        assert not sizes or max(sizes) - min(sizes) <= 1
        assert not sizes or max(sizes) <= 2 * (128 // tier)


def test_empty(spark):
    assert p.pack_documents(docs(spark, []), "doc_id", "text", TIERS).count() == 0
    only = p.pack_documents(docs(spark, [(1, None), (2, "")]), "doc_id", "text", TIERS).collect()
    assert len(only) == 2 and all(r.window_id is None for r in only)
