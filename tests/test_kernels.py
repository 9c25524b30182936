import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.functions import codec, hashing, text
from strandlog.operators import flow, graph, operations, security
from strandlog.runtime import numbered_within, running_by_slots


def column(spark, values, expression, kind="string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expression.alias("x")).collect()]


def test_wildcards(spark):
    assert text.wildcard_to_regex("orders-*") == "^orders-.*$" and text.wildcard_to_regex("a.b?", True) == "^a\\.b\\?$"
    v = F.col("v")
    assert column(spark, ["user-abc-123", "user-abc-12", None], text.wildcard_match(v, "user-*-???")) == [True, False, None]
    assert column(spark, ["a.b", "axb", "a?b"], text.wildcard_match(v, "a?b", True)) == [False, False, True]
    assert column(spark, ["a\nb", "", "x"], text.wildcard_match(v, "*")) == [False, True, True]
    assert column(spark, ["abc", ""], text.has_prefix(v, "")) == [True, True]
    assert text.is_valid_regex(spark, "a+") and not text.is_valid_regex(spark, "a(")
    got = spark.range(1).select(text.match_indices(F.array(F.lit("a"), F.lit(None), F.lit("ab")), lambda x: x.startswith("a")).alias("m")).first().m
    assert got == [0, 2]


def fnv(raw):
    h = hashing.FNV_OFFSET
    for b in raw:
        h = (h ^ b) * hashing.FNV_PRIME % 2**64
    return h


def test_fnv1a_and_partitions(spark):
    values = ["", "a", "foobar", "日本", "x" * 300]
    assert [int(x) for x in column(spark, values, hashing.fnv1a(F.col("v")))] == [fnv(v.encode()) for v in values]
    assert column(spark, [None], hashing.fnv1a(F.col("v"))) == [None]
    parts = column(spark, [f"k{i}" for i in range(1000)], hashing.partition_hash(F.col("v"), 8))
    assert all(parts.count(p) > 50 for p in range(8))
    with pytest.raises(ValueError):
        hashing.partition_hash(F.col("v"), 0)


def test_base64_and_digests(spark):
    values = ["", "a", "ab", "abc", "ÿþ?>", None]
    assert column(spark, values, codec.unbase64url(codec.base64url(F.col("v"))).cast("string")) == values
    assert column(spark, ["a", "!!!!", "YQ==", "YQ"], codec.unbase64url(F.col("v")).cast("string")) == [None, None, "a", "a"]
    assert column(spark, ["abc"], codec.sha256_base64url(F.col("v"))) == ["ungWv48Bz-pBQUDeXa4iI7ADYaOWF3qctBD_YfIAFa0"]
    assert codec.secure_compare("a", b"a") and not codec.secure_compare("a", "ab")


@pytest.mark.parametrize("name", codec.CODECS)
@given(st.binary(max_size=200))
def test_compression_roundtrip(name, raw):
    assert codec.decompress(codec.compress(raw, name), name) == raw


def test_compression_errors_and_stats(spark):
    for name in codec.CODECS:
        assert codec.compression_stats(b"abcd" * 1000, name)["ratio"] > 1
        with pytest.raises(ValueError):
            codec.decompress(b"nonsense nonsense", name)
    with pytest.raises(ValueError):
        codec.compress(b"", "gz")


def test_ed25519_with_the_published_vectors():
    key = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    sig = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert codec.verify_ed25519(b"", sig, key)
    assert not codec.verify_ed25519(b"x", sig, key) and not codec.verify_ed25519(b"", sig[:-1], key) and not codec.verify_ed25519(b"", b"\xff" * 64, key)
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    sig = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    assert codec.verify_ed25519(b"\x72", sig, key)


def test_tokens_and_grants():
    good = {"iss": "me", "exp": 100, "att": [{"with": "store://r/stream/orders-*", "can": "read"}], "sig": "00" * 64}
    import json

    def reason(claims, now):
        with pytest.raises(security.Denied) as e:
            security.verify(claims if isinstance(claims, str) else json.dumps(claims), b"\0" * 32, now)
        return e.value.reason

    assert [reason("{", 1), reason(good, 100), reason(good | {"nbf": 60}, 50), reason(good, 50)] == ["malformed", "expired", "not_yet_valid", "bad_signature"]
    assert security.check_permission(good["att"], "store://r/stream/orders-1", "read")
    with pytest.raises(security.Denied):
        security.check_permission(good["att"], "store://r/stream/orders-1", "write")
    assert security.match_resource("a*", "abc") and security.match_resource("a", "a") and not security.match_resource("a", "ab") and security.match_action("*", "x")
    r = security.Revocations()
    r.revoke("t", now=0)
    r.revoke_issuer("i", now=0)
    assert r.is_revoked("t", 1) and not r.is_revoked("t", 8 * 86400) and r.is_issuer_revoked("i", 9 * 86400)
    r.clean(9 * 86400)
    assert r.all() == {"tokens": [], "issuers": ["i"]}


def test_bounded_queue():
    q = flow.BoundedQueue()
    assert q.info() | {"demand": 0} == {"size": 0, "max_queue": 1000, "strategy": "drop_oldest", "mode": "push", "dropped": 0, "demand": 0, "utilization": 0.0, "warning_at": 800}
    warned = []
    q = flow.BoundedQueue(3, "drop_oldest", warn=warned.append)
    assert q.enqueue_many(range(5)) == 5 and q.dequeue_all() == [2, 3, 4] and q.dropped == 2 and warned == [2, 3, 3]
    q = flow.BoundedQueue(2, "drop_newest")
    q.enqueue_many(range(4))
    assert q.is_full and q.dequeue(5) == [0, 1] and q.is_empty
    for strategy, error in (("block", flow.Blocked), ("error", flow.QueueFull)):
        q = flow.BoundedQueue(1, strategy)
        with pytest.raises(error):
            q.enqueue_many([1, 2, 3])
        assert q.size == 1
    q = flow.BoundedQueue(mode="pull", limit_to_demand=True)
    q.enqueue_many("abc")
    q.add_demand(2)
    assert q.dequeue(3) == ["a", "b"] and q.demand == 0
    assert flow.BoundedQueue().demand == math.inf
    levels, seen = flow.MemoryLevels(), []
    levels.on_change(seen.append)
    assert [levels.check(x) for x in (0.1, 0.7, 0.71, 0.85, 0.2)] == ["normal", "elevated", "elevated", "critical", "normal"] and seen == ["elevated", "critical", "normal"]


def nodes_edges(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")


def test_graph_kernels(spark):
    n, e = nodes_edges(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")])
    assert tuple(graph.graph_stats(n, e).first()) == (4, 3, 1, 1, 3)
    order, whole = graph.topo_levels(n, e)
    assert whole and [(r.node, r.level) for r in order.orderBy("level").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert graph.has_path(e, "a", "d") and not graph.has_path(e, "d", "a") and graph.has_path(e, "zz", "zz")
    assert [r.node for r in graph.ancestors(e, "c").collect()] == ["b", "a"] and [r.node for r in graph.descendants(e, "b").collect()] == ["c", "d"]
    n, e = nodes_edges(spark, ["r1", "r2", "c1", "c2"], [("r1", "c1"), ("r2", "c2")])
    assert tuple(graph.graph_stats(n, e).first()) == (4, 2, 2, 2, 1)
    n, e = nodes_edges(spark, "abc", [("a", "b"), ("b", "c"), ("c", "a")])
    assert graph.has_cycle(n, e) and graph.graph_stats(n, e).first().max_depth == 0 and graph.descendants(e, "a").count() == 2
    n, e = nodes_edges(spark, "a", [("ghost", "a")])
    assert graph.has_cycle(n, e)
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "x"), ("b", "a")], "id string, cause string")
    assert sorted(tuple(r) for r in graph.build_edges(links).collect()) == [("a", "b"), ("a", "b")]
    text_ = graph.to_dot(spark.createDataFrame([('q"', "T", "L")], "node string, type string, label string"), e.limit(0))
    assert '  "q\\"" [label="L\\nT"];' in text_ and "rankdir=TB" in text_


def test_running_results_and_numbers_do_not_depend_on_slots(spark):
    rows = [("a", i, i % 3) for i in range(20)] + [(None, 5, 1), ("b", 7, 2)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    for slot in (1, 4, 100):
        out = running_by_slots(df.withColumn("slot", F.expr(f"at div {slot}")), "k", "slot", ["at"], {"s": ("sum", "v"), "m": ("max", "v")})
        for r in out.collect():
            upto = [v for k, at, v in rows if k == r.k and at <= r.at]
            assert (r.s, r.m) == (sum(upto), max(upto))
    got = {(r.k, r.at): r.n for r in numbered_within(df, "k", ["at"], "n").collect()}
    assert got == {(k, at): sum(1 for q, t, _ in rows if q == k and t < at) for k, at, _ in rows}
    assert numbered_within(df.limit(0), "k", ["at"], "n").count() == 0


def test_operations(spark):
    assert operations.quorum(5, 3) == {"total": 5, "available": 3, "required": 3, "has_quorum": True, "margin": 0}
    rows = [("n", t, ok) for t, ok in enumerate([True, False, False, False, True, False])]
    for slot in (2, 1000):
        got = operations.probe_states(spark.createDataFrame(rows, "node string, at long, ok boolean"), slot=slot).orderBy("at").collect()
        assert [r.state for r in got] == ["healthy", "suspect", "suspect", "failed", "healthy", "suspect"]
        assert [r.recovered for r in got] == [False] * 4 + [True, False]
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c")], "at long, node string")
    assert sorted(tuple(r) for r in operations.membership_changes(s).collect()) == [(2, "b", "removed"), (3, "c", "added")]


def test_config():
    from strandlog.config import StoreConfig

    assert StoreConfig.of("a", {}) == StoreConfig("a", "a-data")
    assert StoreConfig.of("a", {"STORE_MODE": "odd", "STORE_PATH": "/p", "STORE_BUCKETS": "4"}) == StoreConfig("a", "/p", "single", 4)
