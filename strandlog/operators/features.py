"""One wide row per entity from its events, counted by event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.runtime import Scratch, heavy_keys_of_each, key_hash, salt_for

MAX_TYPES = 3000
TOTAL_TYPE = "decimal(28,6)"


def event_types(df: DataFrame, type_col: str, max_types: int = MAX_TYPES) -> list[str]:
    """The distinct non-null event types in order; more than ``max_types`` is an error, never a cut."""
    rows = df.select(F.col(type_col).alias("t")).where("t is not null").distinct().limit(max_types + 1).collect()
    if len(rows) > max_types:
        raise ValueError(f"more than {max_types} event types: wide rows need a bounded set; use layout='map'")
    return sorted(r.t for r in rows)


def column_suffixes(types: list[str]) -> list[str]:
    """Column name endings for event types, told apart even where names match but for case."""
    seen: dict[str, int] = {}
    out = []
    for t in types:
        n = seen.get(t.lower(), 0)
        seen[t.lower()] = n + 1
        out.append(t if n == 0 else f"{t}#{n}")
    return out


def entity_features(
    df: DataFrame,
    entity_col: str,
    type_col: str,
    time_col: str,
    event_col: str,
    order_col: str,
    amount: Column,
    layout: str = "wide",
    types: list[str] | None = None,
    heavy_share: float = 0.005,
    salts: int = 64,
) -> DataFrame:
    """One row per entity: for each event type its count, last time and total amount.

    Columns with layout "wide": ``entity_col, n_events, last_time, total, n_untyped`` and for
    each event type T ``n:T`` (0 if none), ``last:T`` and ``total:T`` (null if none).
    With layout "map": the first five and ``features``, a map from the type to
    struct(n, last_time, total).  Each event counts once, with the row of smallest
    (time, order); ``amount`` may be null and then adds nothing; a total of no amounts is
    null.  Events with a null type count in the first columns only.  A null entity is an
    entity of its own, a null event id is dropped as no event.  An empty table gives no rows.

    Rows are bucketed by entity, an entity with ``heavy_share`` of all rows being split by its
    event ids into ``salts`` buckets, and sorted inside a bucket by entity, type and event.
    This is the only exchange of events.  All further steps run over the sorted runs where
    they lie: repeats fall together, a run of a type becomes its counters, the runs of an
    entity become its wide row, in time linear in types and cells.  Only the partial rows of
    split entities (at most ``salts`` each) are merged by another, small exchange, and only
    events that make up ``heavy_share`` of all rows are reduced before the first.
    """
    if layout not in ("wide", "map"):
        raise ValueError("layout is 'wide' or 'map'")
    _, (heavy, copied) = heavy_keys_of_each(df, [[entity_col], [event_col]], heavy_share)
    rows = df.where(F.col(event_col).isNotNull()).select(
        F.col(entity_col).alias("__e"),
        F.col(type_col).alias("__t"),
        F.col(event_col).alias("__id"),
        F.struct(F.col(time_col).alias("time"), F.col(order_col).alias("ord"), amount.cast(TOTAL_TYPE).alias("amount")).alias("__row"),
    )
    rows = rows.withColumn("__salt", salt_for(heavy, key_hash("__e"), F.xxhash64("__id"), salts))
    if copied:
        # An event with very many copies would fill one bucket: such copies are reduced where they are read.
        many = key_hash("__id").isin(copied)
        rows = rows.where(~many).unionByName(rows.where(many).groupBy("__e", "__salt", "__t", "__id").agg(F.min("__row").alias("__row")).select(*rows.columns))
    bucketed = rows.repartition("__e", "__salt").sortWithinPartitions("__e", "__salt", "__t", "__id")
    bucketed = bucketed.groupBy("__e", "__salt", "__t", "__id").agg(F.min("__row").alias("__row"))
    runs = bucketed.groupBy("__e", "__salt", "__t").agg(F.count(F.lit(1)).alias("n"), F.max("__row.time").alias("last_time"), F.sum("__row.amount").alias("total"))

    def packed(frame: DataFrame, *keys: str) -> DataFrame:
        """The runs of an entity as one array: sparse, so that only types that occur take room."""
        return frame.groupBy(*keys).agg(F.collect_list(F.struct("__t", "n", "last_time", F.col("total").cast("decimal(38,6)").alias("total"))).alias("__cells"))

    rows = packed(runs, "__e", "__salt")
    if heavy:
        # Written once, then read for both kinds of entities: the log itself is not read again.
        rows = Scratch(df.sparkSession, "features").write(rows, "entities")
        split = key_hash("__e").isin(heavy)
        parts = rows.where(split).select("__e", F.inline("__cells"))
        merged = parts.groupBy("__e", "__t").agg(F.sum("n").alias("n"), F.max("last_time").alias("last_time"), F.sum("total").alias("total"))
        rows = rows.where(~split).drop("__salt").unionByName(packed(merged, "__e"))

    cells = F.col("__cells")
    whole = [
        F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("n_events"),
        F.array_max(F.transform(cells, lambda c: c["last_time"])).alias("last_time"),
        F.aggregate(cells, F.lit(None).cast("decimal(38,6)"), lambda s, c: F.coalesce((s + c["total"]).cast("decimal(38,6)"), s, c["total"])).alias("total"),
        F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + F.when(c["__t"].isNull(), c["n"]).otherwise(F.lit(0))).alias("n_untyped"),
    ]
    typed = F.filter(cells, lambda c: c["__t"].isNotNull())
    if layout == "map":
        entry = lambda c: F.struct(c["__t"].alias("type"), F.struct(c["n"].alias("n"), c["last_time"].alias("last_time"), c["total"].alias("total")).alias("cell"))
        return rows.select(F.col("__e").alias(entity_col), *whole, F.map_from_entries(F.array_sort(F.transform(typed, entry))).alias("features"))
    types = event_types(df, type_col) if types is None else types
    rows = rows.select(F.col("__e").alias(entity_col), *whole, _dense(typed, types, rows.schema["__cells"].dataType.elementType).alias("__dense"))
    out = [entity_col, "n_events", "last_time", "total", "n_untyped"]
    for i, name in enumerate(column_suffixes(types)):
        c = F.col("__dense")[i]
        out += [F.coalesce(c["n"], F.lit(0).cast("long")).alias(f"n:{name}"), c["last_time"].alias(f"last:{name}"), c["total"].alias(f"total:{name}")]
    return rows.select(*out)


def _dense(cells: Column, types: list[str], cell_type: T.DataType) -> Column:
    """The cells as an array with one place per type, null where there is none; of each cell only the place is looked up."""
    if not types:
        return F.array().cast(T.ArrayType(cell_type))
    names, none = F.array(*[F.lit(t) for t in types]), F.lit(None).cast(cell_type)
    placed = F.transform(cells, lambda c: F.struct(F.array_position(names, c["__t"]).cast("int").alias("at"), c.alias("cell")))
    placed = F.array_sort(F.filter(placed, lambda p: p["at"] > 0), lambda a, b: a["at"] - b["at"])

    def spread(p: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x["at"]))
        filled = F.flatten(F.zip_with(p, F.slice(before, 1, F.size(p)), lambda c, b: F.concat(F.array_repeat(none, c["at"] - b - 1), F.array(c["cell"]))))
        last = F.coalesce(F.try_element_at(p, F.lit(-1))["at"], F.lit(0))
        return F.concat(filled, F.array_repeat(none, F.lit(len(types)) - last))

    return F.transform(F.array(placed), spread)[0]
