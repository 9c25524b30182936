import random

import pytest
from pyspark.sql import functions as F

from strandlog.llm import repetition as r


def letters(text):
    return "".join(c for c in (text or "") if c.isalpha()).lower()


def brute(text, run=20):
    s = letters(text)
    seen, covered = set(), set()
    for i in range(len(s) - run + 1):
        w = s[i : i + run]
        if w in seen:
            covered.update(range(i, i + run))
        seen.add(w)
    return len(covered) / len(s) if s else 0.0


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    out = [None, "", "   ", "12345 !!!", "short text", "a" * 19, "a" * 20, "a" * 21, "ab" * 400, "Die Größe ist GROSS. " * 30, "日本語の文章を繰り返します" * 40, "🙂 " * 300]
    for n in (5, 60, 300):
        for copies in (0, 1, 2, 9):
            body = " ".join(word() for _ in range(n))
            out.append(body + ", ".join([""] + [" ".join(word() for _ in range(12))] * (copies + 1)) * 1 + body[: len(body) * copies // 10])
    piece = "the same twenty-five letters again"
    out += [" ".join([word(), piece] * k) for k in (1, 2, 3, 30)]
    out.append("x".join(word() for _ in range(900)) + "tail that comes back once more " * 3)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "clash") for i, x in enumerate(rows)], "doc_id long, text string, id string")


def test_share_equals_brute_force(spark):
    rows = texts()
    got = {x.doc_id: x.s for x in frame(spark, rows).select("doc_id", r.repeated_letters(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(rows):
        assert got[i] == pytest.approx(brute(t)), (i, t and t[:60])


@pytest.mark.parametrize("least", [0.1, 0.4, 0.9])
@pytest.mark.parametrize("long_text", [10, 10**6])
def test_found_documents_also_as_long_texts(spark, least, long_text):
    rows = texts()
    got = sorted(x.doc_id for x in r.repeated_documents(frame(spark, rows), "doc_id", "text", least, long_text).collect())
    assert got == [i for i, t in enumerate(rows) if brute(t) >= least and t]


def test_exact_limit(spark):
    # 50 letters, of which the last 20 repeat earlier ones: exactly 0.4
    a = "abcdefghijklmnopqrst"
    text = a + "uvwxyzuvwx" + a
    assert brute(text) == 0.4
    assert r.repeated_documents(frame(spark, [text]), "doc_id", "text", 0.4).count() == 1


def test_ratios(spark):
    rows = ["one line\none line\nother", "- a\n- b\n* c", "wait...\nno…\nyes", "", None, "the of and to", "### !!! a"]
    got = {x.doc_id: x for x in r.measure(frame(spark, rows), "doc_id", "text").collect()}
    assert got[0].repeated_line_share == pytest.approx(8 / 21)
    assert got[1].bullet_line_share == 1 and got[1].bullets
    assert got[2].ellipsis_line_share == pytest.approx(2 / 3)
    for i in (3, 4):
        assert got[i].n_words == 0 and got[i].symbol_share == 0 and got[i].too_short
    assert got[5].stop_word_share == 1
    assert got[6].symbol_share == pytest.approx(6 / 9)
    assert len(got) == len(rows)


def test_one_projection_without_user_functions(spark):
    plan = r.compile_thresholds(frame(spark, ["a"]), "text", r.THRESHOLDS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_unknown_metric_and_empty_table(spark):
    with pytest.raises(ValueError):
        r.compile_thresholds(frame(spark, []), "text", [r.Threshold("x", "nothing", ">=", 1)])
    assert r.measure(frame(spark, []), "doc_id", "text").count() == 0
    assert r.repeated_documents(frame(spark, []), "doc_id", "text").count() == 0


def test_ratios_of_long_texts_are_the_same_on_windows_as_rows(spark, monkeypatch):
    rows = frame(spark, texts()).selectExpr("nullif(doc_id % 5, 0) AS doc_id", "text", "id")  # repeated and null ids
    want = sorted(map(str, r.measure(rows, "doc_id", "text").collect()))
    sizes, spread = [], r._long_texts
    monkeypatch.setattr(r, "_long_texts", lambda df, *a: sizes.append(df.count()) or spread(df, *a))
    got = sorted(map(str, r.measure(rows, "doc_id", "text", long_text=30).collect()))
    assert got == want and sizes == [sum(len(t or "") > 30 for t in texts())]


@pytest.mark.parametrize("width", [32, 64])
def test_long_texts_by_blocks_of_letters(spark, width):
    rows = [*texts(), "a" * 700, "abc" * 333, "a" * 64 + "b" * 64 + "a" * 64]
    got = {x.id: x.share for x in r._long_texts(frame(spark, rows).select("doc_id", "text"), "doc_id", "text", width=width).collect()}
    assert got == {i: pytest.approx(brute(t)) for i, t in enumerate(rows)}


def test_stop_words_of_each_language_and_scripts_without_spaces(spark):
    rows = ["これは日本の公園で、子どもたちが遊んでいるのを見ることができます。", "ذهب الولد إلى المدرسة في الصباح مع صديقه من أجل الدرس", "Το παιδί και η μητέρα του είναι στο σπίτι με την γάτα", "xq zzkw vvbr qqj wwpl"]
    got = [x for x in r.measure(frame(spark, rows), "doc_id", "text").orderBy("doc_id").collect()]
    assert got[0].n_words > 20 and not got[0].too_short
    assert [x.few_stop_words for x in got] == [False, False, False, True]
