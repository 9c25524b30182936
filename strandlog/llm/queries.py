"""Queries of the text problems over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import packing, repetition, tokenizer
from strandlog.sources.tables import table


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p7_reuse(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.chunk_reuse(table(spark, folder, "documents"), "doc_id", "text")


def p8_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.window_fill(packing.pack_documents(table(spark, folder, "documents"), "doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repeated_documents(table(spark, folder, "documents"), "doc_id", "text")


def p9_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.measure(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids, "p7_reuse": p7_reuse, "p8_windows": p8_windows, "p8_fill": p8_fill, "p9_found": p9_found, "p9_ratios": p9_ratios}

P9_FOUND_SQL = r"""
WITH t AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, substr(s, i, 20) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 18)) AS i FROM t)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY i) > 1),
c AS (SELECT doc_id, least(20, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 20)) AS n FROM r)
SELECT doc_id FROM c JOIN t USING (doc_id) GROUP BY doc_id, length(s) HAVING sum(n) >= 0.4 * length(s)"""

def _ratios_sql() -> str:
    """The default threshold table in SQL; the letter runs as in p9_found, for every document."""
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0.0 END"
    chars = lambda parts: f"coalesce(list_sum(list_transform({parts}, lambda x: length(x))), 0)"
    repeat = lambda parts: share(f"({chars(parts)} - {chars(f'list_distinct({parts})')})", chars(parts))
    cut = lambda at: f"list_filter(list_transform(string_split_regex(t, '{at}'), lambda x: trim(x, ' ')), lambda x: x <> '')"
    stops = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own)})))" for own in repetition.STOP_WORDS.values())
    single = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
    ratios = {
        "n_words": "CAST(len(w) AS DOUBLE)",
        "symbol_share": share(r"length(regexp_replace(t, '[\p{L}\p{N} \t-\r]+', '', 'g'))", "length(t)"),
        "stop_word_share": share(f"greatest({stops})", "len(w)"),
        "bullet_line_share": share("len(list_filter(l, lambda x: regexp_matches(x, '^[-*•·]')))", "len(l)"),
        "ellipsis_line_share": share(r"len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\z')))", "len(l)"),
        "repeated_line_share": repeat("l"),
        "repeated_block_share": repeat("b"),
        "repeated_sentence_share": repeat("s"),
        "repeated_words5_share": share("(len(g) - len(list_distinct(g)))", "len(g)"),
        "repeated_letter_share": "coalesce(r.share, 0.0)",
    }
    flags = ", ".join(f"{x.metric} {x.op} {x.value} AS {x.flag}" for x in repetition.THRESHOLDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(string_split_regex(regexp_replace(lower(t), '({single})', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}'']+'), lambda x: x <> '') AS w, {cut(r"\n")} AS l, {cut(r"\n[ \t-\r]*\n")} AS b, {cut(r"[.!?。！？]+[ \t-\r]*|\n+")} AS s FROM d),
q AS (SELECT *, CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM p),
a AS (SELECT doc_id, lower(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS x FROM d),
v AS (SELECT doc_id, i, substr(x, i, 20) AS v FROM (SELECT doc_id, x, unnest(range(1, length(x) - 18)) AS i FROM a)),
f AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, v ORDER BY i) > 1),
c AS (SELECT doc_id, least(20, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 20)) AS n FROM f),
r AS (SELECT doc_id, CAST(sum(n) AS DOUBLE) / max(length(x)) AS share FROM c JOIN a USING (doc_id) GROUP BY doc_id),
m AS (SELECT q.doc_id, {", ".join(f"{e} AS {k}" for k, e in ratios.items())} FROM q LEFT JOIN r USING (doc_id))
SELECT *, {flags} FROM m"""


ORACLES = {"p9_found": P9_FOUND_SQL, "p9_ratios": _ratios_sql()}
