"""Patterns on strings: wildcards, regular expressions, prefixes and suffixes, on columns, frames and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPECIAL = set("\\^$.|+()[]{}")


def wildcard_to_regex(pattern: str, question_literal: bool = False) -> str:
    """An anchored expression: ``*`` is any run of characters, ``?`` one character (or itself), the rest is literal."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append("\\?" if question_literal else ".")
        else:
            out.append("\\" + ch if ch in _SPECIAL else ch)
    return "^" + "".join(out) + "$"


def wildcard_match(text: Column, pattern: str, question_literal: bool = False) -> Column:
    """True where the whole text matches; what stands before the first wildcard is also tested as a prefix, which a scan can use."""
    full = text.rlike(wildcard_to_regex(pattern, question_literal))
    head = pattern[: min((pattern.find(c) for c in "*?" if c in pattern), default=len(pattern))]
    return text.startswith(head) & full if head else full


def regex_match(text: Column, expression: str) -> Column:
    """True where the expression is found anywhere in the text."""
    return text.rlike(expression)


def has_prefix(text: Column, prefix: str) -> Column:
    return text.startswith(prefix)


def has_suffix(text: Column, suffix: str) -> Column:
    return text.endswith(suffix)


def is_valid_regex(spark: SparkSession, expression: str) -> bool:
    """Does the expression compile in the engine that will run it?"""
    try:
        spark._jvm.java.util.regex.Pattern.compile(expression)
        return True
    except Exception:
        return False


def filter_by_wildcard(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(wildcard_match(F.col(column), pattern))


def filter_by_regex(df: DataFrame, column: str, expression: str) -> DataFrame:
    return df.where(F.col(column).rlike(expression))


def filter_by_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def filter_by_suffix(df: DataFrame, column: str, suffix: str) -> DataFrame:
    return df.where(F.col(column).endswith(suffix))


def match_indices(items: Column, test: Callable[[Column], Column]) -> Column:
    """Places, from 0, of the array's items that pass the test; null items never do."""
    places = F.transform(items, lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), i))
    return F.filter(places, lambda i: i.isNotNull())


def count_matches(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(match_indices(items, test))
