"""Results per key when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.runtime import heavy_keys, key_hash, salt_for

#: Aggregates that can be merged from partial results: how to make one and how to merge.
_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """One result column.

    ``kind`` is count, sum, min, max, min_by, max_by or count_distinct; ``column`` None
    counts rows; ``order`` is the ordering column of min_by and max_by (ties: the smaller,
    or for max_by the larger, ``column``).
    """

    name: str
    kind: str
    column: str | None = None
    order: str | None = None


def _value(m: Measure):
    if m.kind in ("min_by", "max_by"):
        return F.when(F.col(m.order).isNotNull(), F.struct(F.col(m.order).alias("o"), F.col(m.column).alias("v")))
    return F.lit(1) if m.column is None else F.col(m.column)


def _fold(kind: str, merging: bool):
    return {"min_by": F.min, "max_by": F.max}.get(kind) or (_MERGE if merging else _PARTIAL)[kind]


@dataclass(frozen=True)
class SaltedResult:
    """The per-key rows, and the number of input rows found on the way."""

    frame: DataFrame
    total_rows: int
    heavy: list[int]


def spread_hash(df: DataFrame, columns: list[str]):
    """A hash of the row's values in ``columns``; maps, which Spark does not hash, as their entries."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return F.xxhash64(*[F.map_entries(c) if kinds[c] == "map" else F.col(c) for c in columns])


def salted_aggregate(df: DataFrame, keys: list[str], measures: list[Measure], heavy_share: float = 0.005, salts: int = 64, spread: list[str] | None = None) -> SaltedResult:
    """One row per key with the given measures, no task bound to one heavy key.

    1. Keys with at least ``heavy_share`` of all rows are found by a sketch of bounded size
       in one pass; no more than about ``1 / heavy_share`` of them exist.
    2. Rows are reduced per (key, salt), the salt of a heavy key being drawn from the
       row's values: those of ``spread`` if given, else those the measures name, else all
       columns (maps as their entries).  With a count_distinct measure the values are first made unique per
       key, spread over all tasks by (key, value), and the salt is drawn from the value, so
       the salts hold disjoint values and their counts add up.
    3. The partial rows, at most ``salts`` for a key, are merged by the key.

    Null keys form one group, as in GROUP BY.  count(column), sum, min and max skip
    nulls; count_distinct skips nulls.  An empty table gives no rows.  Columns that are
    not named here play no part, whatever they are called.  At most one column may be
    counted distinct in one call.
    """
    distinct = sorted({m.column for m in measures if m.kind == "count_distinct"})
    if len(distinct) > 1:
        raise ValueError("one count_distinct column a call")
    total, heavy = heavy_keys(df, keys, heavy_share)
    plain = [m for m in measures if m.kind != "count_distinct"]
    used = list(dict.fromkeys([c for m in plain for c in (m.column, m.order) if c] + distinct))
    k = [f"__k{i}" for i in range(len(keys))]
    values = [_value(m).alias(f"__v{i}") for i, m in enumerate(plain)]
    named = [F.col(c).alias(a) for c, a in zip(keys, k)]

    if distinct:
        rows = df.select(*named, F.col(distinct[0]).alias("__d"), *values).groupBy(*k, "__d")
        rows = rows.agg(F.lit(1).alias("__one"), *[_fold(m.kind, False)(f"__v{i}").alias(f"__p{i}") for i, m in enumerate(plain)])
        salted = rows.withColumn("__salt", salt_for(heavy, key_hash(*k), F.xxhash64("__d"), salts))
        partial = salted.groupBy(*k, "__salt").agg(F.count("__d").alias("__nd"), *[_fold(m.kind, True)(f"__p{i}").alias(f"__p{i}") for i, m in enumerate(plain)])
    else:
        drawn = spread_hash(df, spread or used or df.columns)
        salted = df.select(*named, *values, salt_for(heavy, key_hash(*keys), drawn, salts).alias("__salt"))
        partial = salted.groupBy(*k, "__salt").agg(F.lit(0).alias("__nd"), *[_fold(m.kind, False)(f"__v{i}").alias(f"__p{i}") for i, m in enumerate(plain)])

    merged = partial.groupBy(*k).agg(F.sum("__nd").alias("__nd"), *[_fold(m.kind, True)(f"__p{i}").alias(f"__p{i}") for i, m in enumerate(plain)])
    slots = {m.name: i for i, m in enumerate(plain)}
    out = []
    for m in measures:
        if m.kind == "count_distinct":
            c = F.col("__nd").cast("long")
        elif m.kind in ("min_by", "max_by"):
            c = F.col(f"__p{slots[m.name]}.v")
        else:
            c = F.col(f"__p{slots[m.name]}")
        out.append(c.alias(m.name))
    return SaltedResult(merged.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], *out), total, heavy)


def keys_with_share(df: DataFrame, key: str, share: float | Fraction, heavy_share: float = 0.005, salts: int = 64, spread: list[str] | None = None) -> DataFrame:
    """The non-null keys that hold at least ``share`` of all rows, with their row counts.

    An empty table has none.  The comparison is made in whole numbers on both sides of
    ``rows >= share * total``.  ``spread`` names what tells a key's rows apart (all columns
    if not given, which then are all read).
    """
    limit = Fraction(share).limit_denominator(10**6)
    r = salted_aggregate(df, [key], [Measure("n_rows", "count")], heavy_share, salts, spread)
    least = -(-r.total_rows * limit.numerator // limit.denominator)  # the least whole number that reaches the share
    return r.frame.where(F.col(key).isNotNull() & (F.col("n_rows") >= least))
