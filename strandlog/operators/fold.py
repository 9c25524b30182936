"""The tagged fold: event data reduced to a state, key by key, in version order.

A value ``{"sum": number}`` adds to the key, ``{"overwrite": v}`` and any other value sets
it.  For one key the result is the last value set, or, if sums follow it, its number (0
for anything that is no number) plus these sums.  Both parts are partial aggregates, so no
stream's events need to be collected in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.runtime import block_of

NUMBER = "decimal(38,6)"
#: Versions per block of the first reduction.
BLOCK = 16_384


def data_fields(data: Column) -> Column:
    """The top-level fields of JSON object text as a map of variants; null for anything else."""
    return F.try_parse_json(data).try_cast("map<string,variant>")


#: Kinds of plain numbers, and of an object that holds nothing but a numeric sum.
_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_SUM = "^OBJECT<sum: (BIGINT|DECIMAL[^,]*(,[0-9]+)?[)]?|DOUBLE|FLOAT)>$"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return _kind(v).rlike(_NUMBER)


def field_number(v: Column) -> Column:
    """The number of a plain number or of a tagged sum; null for all else."""
    tagged = F.try_variant_get(v, "$.sum", "variant")
    only = _kind(v).rlike(_SUM)
    return F.when(_is_number(v), v.try_cast(NUMBER)).when(only, tagged.try_cast(NUMBER))


def fold_ops(log: DataFrame, group: str = "stream_id", position: str = "version") -> DataFrame:
    """One row per field of each event: ``group, position, field, delta`` (a sum) or ``set_to`` (JSON text) with ``set_number``.

    Events whose data is no JSON object give none.
    """
    fields = log.select(F.col(group).alias("group"), F.col(position).alias("position"), F.explode(data_fields(F.col("data"))).alias("field", "v"))
    # The kind of a value is made once and decides what else is looked at.
    kind = F.col("kind")
    fields = fields.withColumn("kind", F.schema_of_variant("v"))
    over = kind.startswith("OBJECT<overwrite: ") & (F.size(F.col("v").try_cast("map<string,variant>")) == 1)
    ops = fields.select(
        "group", "position", "field", "kind", "v",
        F.when(kind.rlike(_SUM), F.try_variant_get("v", "$.sum", NUMBER)).alias("delta"),
        F.when(over, F.try_variant_get("v", "$.overwrite", "variant")).alias("inner"),
    )
    is_set = F.col("delta").isNull()
    inner_number = F.when(F.col("inner").isNotNull() & _is_number(F.col("inner")), F.try_variant_get("inner", "$", NUMBER))
    return ops.select(
        "group", "position", "field", "delta",
        F.when(is_set, F.coalesce(F.to_json("inner"), F.to_json("v"), F.lit("null"))).alias("set_to"),
        F.when(is_set, F.when(kind.rlike(_NUMBER), F.try_variant_get("v", "$", NUMBER)).otherwise(inner_number)).alias("set_number"),
    )


def _reduce(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Reduce ``set, base, text, tail, tailed`` rows in ``order`` within ``keys`` to one row of the same kind.

    ``set`` tells whether the part sets the key; ``tail`` is the sum after its last set, or
    all of its sums; ``tailed`` whether any sum counts there.  The last set is found first, then
    everything from it on is added up, so nothing is collected and only the keys are sorted.
    """
    at = F.when(F.col("set"), F.col(order))
    counts = F.col("last").isNull() | (F.col(order) >= F.col("last"))
    marked = rows.withColumn("last", F.max(at).over(Window.partitionBy(*keys)))
    is_last = F.col("set") & (F.col(order) == F.col("last"))
    return marked.groupBy(*keys).agg(
        F.max("set").alias("set"), F.coalesce(F.max(F.when(is_last, F.col("base"))), F.lit(0).cast(NUMBER)).alias("base"), F.max(F.when(is_last, F.col("text"))).alias("text"),
        F.coalesce(F.sum(F.when(counts, F.col("tail"))).cast(NUMBER), F.lit(0).cast(NUMBER)).alias("tail"), F.max(counts & F.col("tailed")).alias("tailed"),
    )


def tagged_fold(ops: DataFrame, direction: str = "forward", initial: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``group, field, number, value`` of every key after all ops.

    ``number`` is set where the state is numeric, ``value`` is JSON text (the number's, or
    what was set last).  ``backward`` folds from the newest to the oldest, so that of plain
    values the oldest stays.  ``initial`` (``group, field, number, value``) is the state
    before the first op.  Each group is reduced by blocks of ``block`` positions and the
    blocks by their order, so a hot group is spread.  Positions must be unique per group.
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction is 'forward' or 'backward'")
    o = F.col("position") if direction == "forward" else -F.col("position")
    zero = F.lit(0).cast(NUMBER)
    rows = ops.select(
        "group", "field", o.alias("o"), F.col("delta").isNull().alias("set"), F.coalesce("set_number", zero).cast(NUMBER).alias("base"), F.when(F.col("delta").isNull(), F.struct(F.col("set_to").alias("json"), F.col("set_number").alias("number"))).alias("text"),
        F.coalesce("delta", zero).cast(NUMBER).alias("tail"), F.col("delta").isNotNull().alias("tailed"),
    ).withColumn("block", block_of("o", block))
    parts = _reduce(rows, ["group", "field", "block"], "o")
    if initial is not None:
        first = initial.select(
            "group", "field", F.lit(-(2**62)).alias("block"), F.lit(True).alias("set"), F.coalesce("number", zero).cast(NUMBER).alias("base"), F.struct(F.col("value").alias("json"), F.col("number").cast(NUMBER).alias("number")).alias("text"), zero.alias("tail"), F.lit(False).alias("tailed")
        )
        parts = parts.unionByName(first)
    whole = _reduce(parts, ["group", "field"], "block")
    number = F.when(F.col("tailed"), (F.col("base") + F.col("tail")).cast(NUMBER)).otherwise(F.col("text.number"))
    return whole.select("group", "field", number.alias("number"), F.coalesce(F.when(F.col("tailed"), number.cast("string")), F.col("text.json")).alias("value"))


def finalized(state: Column) -> Column:
    """A map of JSON texts with ``{"sum": n}`` and ``{"overwrite": v}`` unwrapped, other values as they are."""

    def one(_: Column, t: Column) -> Column:
        v = F.try_parse_json(t)
        single = F.size(v.try_cast("map<string,variant>")) == 1
        over = F.try_variant_get(v, "$.overwrite", "variant")
        total = F.try_variant_get(v, "$.sum", "variant")
        return F.when(single & total.isNotNull() & _is_number(total), F.to_json(total)).when(single & over.isNotNull(), F.to_json(over)).otherwise(t)

    return F.transform_values(state, one)


def aggregate_state(log: DataFrame, snapshots: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """State of every stream: the latest snapshot, if it has one, and the events after it.

    ``snapshots`` has ``stream_id, version, data``.  A stream with a snapshot starts from its
    data (nothing, if that is no object) and ignores ``initial``; equal to a full replay
    wherever snapshots were made by replay.
    """
    if snapshots is None:
        return tagged_fold(fold_ops(log), initial=initial)
    # The key of a latest snapshot is unique per stream.
    latest = snapshots.groupBy("stream_id").agg(F.max_by(F.struct("version", "data"), "version").alias("s")).select(F.col("stream_id").alias("s_stream"), F.col("s.version").alias("s_version"), F.col("s.data").alias("s_data"))
    tail = log.join(latest.select("s_stream", "s_version"), F.col("stream_id") == F.col("s_stream"), "left").where("s_version is null or version > s_version")
    start = latest.select(F.col("s_stream").alias("group"), F.explode(data_fields(F.col("s_data"))).alias("field", "v"))
    start = start.select("group", "field", field_number(F.col("v")).alias("number"), F.to_json("v").alias("value"))
    if initial is not None:
        start = start.unionByName(initial.join(latest, F.col("group") == F.col("s_stream"), "left_anti"))
    return tagged_fold(fold_ops(tail), initial=start)


def sum_field(log: DataFrame, field: str, by: str | None = None) -> DataFrame:
    """Sum of a field that is a number or a tagged sum; anything else is skipped; 0 for none."""
    value = field_number(data_fields(F.col("data"))[field])
    out = log.withColumn("__v", value)
    grouped = out.groupBy(by) if by else out.groupBy()
    return grouped.agg(F.coalesce(F.sum("__v"), F.lit(0)).cast(NUMBER).alias("total"))


def count_where(log: DataFrame, field: str, value: str | None, by: str | None = None) -> DataFrame:
    """Events whose field equals the JSON text ``value``; null asks for a missing field.  1 and 1.0 differ."""
    text = F.to_json(data_fields(F.col("data"))[field])
    out = log.withColumn("__hit", text.eqNullSafe(F.lit(value)))
    grouped = out.groupBy(by) if by else out.groupBy()
    return grouped.agg(F.count_if("__hit").alias("n"))


def merge_tagged(pairs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Apply ``group, position, field, value`` (JSON text) pairs in order to a state."""
    log = pairs.select("group", "position", F.concat(F.lit("{"), F.to_json(F.col("field").cast("variant")), F.lit(":"), F.col("value"), F.lit("}")).alias("data"))
    return tagged_fold(fold_ops(log, "group", "position"), initial=state)


def aggregation_stats(log: DataFrame, by: str | None = None) -> DataFrame:
    """``total_events, events_with_data`` (an object with fields) and ``unique_fields`` over all of them."""
    keys = F.map_keys(data_fields(F.col("data")))
    rows = log.select(*([F.col(by).alias("g")] if by else [F.lit(0).alias("g")]), keys.alias("k"))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("total_events"), F.count_if(F.size("k") > 0).alias("events_with_data"))
    # Distinct names are few: they are combined before they are exchanged.
    names = rows.select("g", F.explode("k").alias("k")).distinct().groupBy(F.col("g").alias("n_g")).agg(F.count(F.lit(1)).alias("unique_fields"))
    out = counts.join(names, F.col("g").eqNullSafe(F.col("n_g")), "left").select("g", "total_events", "events_with_data", F.coalesce("unique_fields", F.lit(0)).alias("unique_fields"))
    return out.withColumnRenamed("g", by) if by else out.drop("g")
