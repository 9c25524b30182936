import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlog.llm import tokenizer as t

SCHEMA = "doc_id long, text string, ids string, doc string, seq int"
HARD = [
    None, "", " ", "\n\n\t ", "a", "don't we'll I'VE 'tis ''s", "<|endoftext|> text <|endoftext|>", "x" * 5000, " " * 3000, "\n" * 2000 + "a", "a \n" * 700,
    "日本語の文章です。これは二番目の文、そして三番目。" * 60, "漢字" * 900, "ひらがな、カタカナ。" * 80, "éä " * 200, "🙂🙃👩‍👩‍👧 ok " * 90, "  　 a b   c\u0085 d" * 60, "​﻿\x00\x01 text" * 90,
    "0123456789" * 300 + " end", "αβγ ελληνικά кириллица العربية " * 70, "tab\tsep\tvalues\n" * 200, "a" * 31 + " " + "b" * 33 + "  c", "ab" * 40 + "。" + "語。" * 500,
]


@pytest.fixture(scope="module")
def enc():
    return t.encoder(t.vocabulary_bytes())


def run(spark, rows):
    df = spark.createDataFrame([(i, x, "clash", "clash", 1) for i, x in rows], SCHEMA)
    return [(r.doc_id, r["ids"]) for r in t.encode_corpus(df, "doc_id", "text").collect()]


def want(enc, rows):
    return sorted(((i, enc.encode_ordinary(x) if x else []) for i, x in rows), key=str)


def mixed(seed, n=120):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(HARD[5:]) or "" for _ in range(2))[:700] for _ in range(5)]
    words = ["the", "quick", "naïve", "日本", "42", "...", "don't", "\n", "  ", "。", "🙂", " ", "x" * 40]
    return [(i, rng.choice(shared) + " ".join(rng.choice(words) for _ in range(rng.randrange(300))) + rng.choice(shared)) for i in range(n)]


def test_equals_encoding_of_whole_texts(spark, enc):
    rows = list(enumerate(HARD)) + [(1000 + i, x) for i, x in mixed(1)]
    assert sorted(run(spark, rows), key=str) == want(enc, rows)


def test_repeated_rows_and_null_ids(spark, enc):
    rows = [(1, "same text " * 90)] * 3 + [(None, "other"), (None, None), (2, "same text " * 90)]
    assert sorted(run(spark, rows), key=str) == want(enc, rows)


def test_a_chunk_in_very_many_documents(spark, enc, monkeypatch):
    monkeypatch.setattr(t, "SPREAD_AFTER", 3)
    rows = [(i, "All rights reserved. " * 40 + str(i)) for i in range(60)]
    assert sorted(run(spark, rows), key=str) == want(enc, rows)


def test_empty_table_and_count(spark, enc):
    assert run(spark, []) == []
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(HARD)], "i long, body string, text int")
    got = {r.i: r.n_tokens for r in t.count_tokens(df.select("i", "body"), "body").collect()}
    assert got == {i: len(enc.encode_ordinary(x)) if x else 0 for i, x in enumerate(HARD)}


def cut(text):
    import numpy as np

    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    edges, joint = t.pieces(data, np.array([0]), np.array([len(raw)]))
    return [raw[a:z].decode() for a, z in zip(edges[:-1], edges[1:])], joint


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_pieces_encode_like_the_whole(enc, bits, monkeypatch):
    monkeypatch.setattr(t, "CUT_BITS", bits)
    monkeypatch.setattr(t, "LEAST_CHUNK", 1)
    for text in [x for x in HARD if x] + [x for _, x in mixed(2, 20)]:
        parts, _ = cut(text)
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 　 \u0085。、ひ漢字ab'sld1.🙂́"), st.characters(codec="utf-8")), max_size=200))
def test_any_text_is_cut_at_sure_boundaries_only(enc, text):
    import numpy as np

    raw = text.encode()
    at = [0, *t.sure_boundaries(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
    assert [i for a, z in zip(at, at[1:]) for i in enc.encode_ordinary(raw[a:z].decode())] == enc.encode_ordinary(text)


def test_hash_looks_back_the_same_over_array_blocks(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(5).randbytes(5000).replace(b"\x80", b"a"), np.uint8)
    whole = t.rolling_cuts(data), t.sure_boundaries(data)
    monkeypatch.setattr(t, "BLOCK", 257)
    assert (t.rolling_cuts(data) == whole[0]).all() and (t.sure_boundaries(data) == whole[1]).all()


def test_long_runs_of_white_space(spark, enc, monkeypatch):
    texts = ["a" + " " * n + e for n in (1, 2, 3, 40, 41) for e in ("", "b", "\n", "\nb", "!", "é")] + ["\n" * 50, "\u3000" * 45 + "x", " \t" * 30 + "y  z"]
    for least in (2, 40):
        monkeypatch.setattr(t, "LONG_RUN", least)
        for x in texts:
            assert t.ordinary(enc, x) == enc.encode_ordinary(x), repr(x)
    monkeypatch.undo()
    huge = ["word" + " " * 1_200_000 + "end " * 3, "\n" * 700_000, "z" * 300_000 + "\t " * 400_000]
    got = dict(run(spark, list(enumerate(huge))))
    assert all(enc.decode(got[i]) == x for i, x in enumerate(huge))
    assert got[0][:1] == enc.encode_ordinary("word") and got[0][-3:] == enc.encode_ordinary(" end end end ")[-3:]


def test_a_chunk_of_all_tasks_is_spread_and_a_rare_one_is_not(spark):
    text = "All rights reserved, and every word of this notice lies in each of the pages. " * 40
    df = spark.createDataFrame([(i, text) for i in range(400)] + [(i, f"only {i} " + "twice in all " * 90) for i in range(2)], "doc_id long, text string").repartition(20)
    cut, *_ = t._cut(df, "doc_id", "text", t.VOCABULARY_DIR, t.VOCABULARY)
    per = cut.where("ids IS NULL").groupBy("digest", "salt").count().groupBy("digest").agg({"salt": "count", "count": "sum"}).collect()
    hot = [r for r in per if r["sum(count)"] >= 400]
    assert hot and all(r["count(salt)"] > 2 for r in hot)
    assert all(r["count(salt)"] == 1 for r in per if r["sum(count)"] <= 4)


def test_texts_without_white_space_are_cut_and_shared(spark, enc):
    rng = random.Random(5)
    blob = "".join(rng.choice("abcXYZ0189+/=;(){}'._") for _ in range(20_000))
    thai = "".join(rng.choice(["ที่", "การ", "ประเทศ", "ไทย", "และ", "เป็น", "น้ำ", "ผู้"]) for _ in range(3000))
    rows = [(i, f"{i}{blob}{i}") for i in range(4)] + [(9 + i, f"{'x' * i}{thai}") for i in range(4)]
    assert sorted(run(spark, rows), key=str) == want(enc, rows)
    r = t.chunk_reuse(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text").first()
    assert r.encoded_bytes < 0.4 * r.chunk_bytes


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab'sStTrRe1 9.-\"\t\n\u0e01\u0e31\u0e49\u0e30é\u00a0。の"), max_size=40))
def test_sure_boundaries_are_boundaries(enc, text):
    import numpy as np

    raw = text.encode()
    for at in t.sure_boundaries(np.frombuffer(raw, np.uint8)).tolist():
        assert enc.encode_ordinary(raw[:at].decode()) + enc.encode_ordinary(raw[at:].decode()) == enc.encode_ordinary(text), at
