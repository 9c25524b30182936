import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlog.operators import hierarchy as h

SCHEMA = "id string, up string, num string, path string"


def frame(spark, links):
    return spark.createDataFrame([(a, b, "extra", "extra") for a, b in links], SCHEMA)


def brute(links):
    parent = {}
    for a, b in links:
        if a is None:
            continue
        old = parent.get(a)
        b = b or None
        parent[a] = b if old is None else old if b is None else min(old, b)
    out = {}
    for a in parent:
        path, x = [], a
        while True:
            path.append(x)
            up = parent[x]
            if up is None or up not in parent:
                out[a] = (x, len(path) - 1, list(reversed(path)))
                break
            if up in path:
                out[a] = (min(path[path.index(up):]), -1, None)
                break
            x = up
    return out


def check(spark, links):
    rows = h.hierarchy(frame(spark, links), "id", "up", with_paths=True)
    got = rows.collect()
    want = brute(links)
    assert len(got) == len(want)
    assert {r.node: (r.root, r.depth, r.path) for r in got} == want
    pairs = {(r.ancestor, r.node, r.distance) for r in h.effects(rows).collect()}
    assert pairs == {(p, a, len(path) - 1 - i) for a, (_, d, path) in want.items() if d > 0 for i, p in enumerate(path[:-1])}


def test_chains_circles_and_dirty_rows(spark):
    links = [("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("d", ""), ("e", "nowhere"), ("f", "e"), ("self", "self"), ("s2", "self"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "x"), ("u", "t"), (None, "a"), ("b", None)]
    links += [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(70)]
    check(spark, links)


def test_long_circle_with_a_tail_whose_ids_are_smaller(spark):
    circle = [(f"m{i:02}", f"m{(i + 1) % 13:02}") for i in range(13)]
    tail = [(f"a{i:02}", f"a{i - 1:02}" if i else "m05") for i in range(21)]
    check(spark, circle + tail)


def test_random_forest_with_hot_parent_is_spread(spark, monkeypatch):
    monkeypatch.setattr(h, "HEAVY_SHARE", 0.1)
    rng = random.Random(4)
    links = [("r", None), ("hub", "r")] + [(f"k{i}", "hub") for i in range(60)] + [(f"g{i}", f"k{rng.randrange(60)}") for i in range(40)] + [(f"h{i}", f"g{rng.randrange(40)}") for i in range(40)]
    check(spark, links)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from(["a", "b", "c", "d", "e", "f", "g", "h", "q", "", None])), max_size=14))
def test_any_links(spark, links):
    check(spark, links)


def test_only_children(spark):
    got = h.hierarchy(frame(spark, [("a", None), ("b", "a"), ("c", "no")]), "id", "up", only_children=True).collect()
    assert {(r.node, r.root, r.depth) for r in got if r.parent is not None} == {("b", "a", 1), ("c", "c", 0)}


def test_empty(spark):
    assert h.hierarchy(frame(spark, []), "id", "up").count() == 0


def walks(links):
    """Of each node the ids met going up from it, itself first, each once."""
    parent = {a: b for a, b in links}
    out = {}
    for a in parent:
        out[a] = [a]
        while (up := parent[out[a][-1]]) in parent and up not in out[a]:
            out[a].append(up)
    return out


def test_nodes_in_and_below_circles_have_effects(spark):
    links = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("self", "self"), ("s2", "self"), ("r", None), ("k", "r")]
    links += [(f"m{i:02}", f"m{(i + 1) % 13:02}") for i in range(13)] + [(f"t{i:02}", f"t{i - 1:02}" if i else "m05") for i in range(21)]
    rows = h.hierarchy(frame(spark, links), "id", "up", with_paths=True, with_walks=True)
    want = walks(links)
    assert {r.node: r.walk for r in rows.where("depth < 0").collect()} == {a: w for a, w in want.items() if a not in ("r", "k")}
    assert rows.where("depth >= 0 and walk is not null").count() == 0
    got = [tuple(r) for r in h.effects(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, a, i) for a, w in want.items() for i, p in enumerate(w) if i}
    assert {("c", "d", 1), ("a", "c", 1), ("a", "d", 2), ("b", "d", 3), ("b", "a", 1), ("a", "b", 1)} <= set(got)


def test_walks_need_paths(spark):
    with pytest.raises(ValueError):
        h.hierarchy(frame(spark, []), "id", "up", with_walks=True)
