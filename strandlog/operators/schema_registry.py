"""Schemas of event types: versions, steps from one version's data to the next, validation."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.shared_state import SharedState

VERSION_KEY = "schema_version"


@dataclass
class EventSchema:
    """``upcast_from`` maps a version v to the step from v to v + 1; steps and validator are functions on the data column."""

    version: int
    upcast_from: dict[int, Callable[[Column], Column]] = field(default_factory=dict)
    validator: Callable[[Column], Column] | None = None
    description: str | None = None
    registered_at: int | None = None


class SchemaRegistry:
    """Schemas by event type, durable if a folder is given."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self._state = SharedState(spark, path)

    @property
    def _schemas(self) -> dict[str, EventSchema]:
        return self._state.read()

    def register(self, event_type: str, schema: EventSchema) -> None:
        if not isinstance(schema.version, int) or isinstance(schema.version, bool) or schema.version < 1:
            raise ValueError(f"invalid_version: {schema.version}")
        if schema.registered_at is None:
            schema.registered_at = time.time_ns() // 1_000_000
        self._state.change(lambda schemas: schemas.update({event_type: schema}))

    def register_all(self, schemas: dict[str, EventSchema]) -> None:
        """Several schemas in one change, all or none."""
        checked = SchemaRegistry()
        for t, x in schemas.items():
            checked.register(t, x)
        self._state.change(lambda state: state.update(schemas))

    def unregister(self, event_type: str) -> None:
        self._state.change(lambda schemas: schemas.pop(event_type, None))

    def get(self, event_type: str) -> EventSchema:
        return self._schemas[event_type]

    def get_version(self, event_type: str) -> int:
        return self._schemas[event_type].version

    def list(self) -> list[tuple[str, int, int]]:
        return [(t, s.version, s.registered_at) for t, s in sorted(self._schemas.items())]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, s.version, s.description, s.registered_at) for t, s in sorted(self._schemas.items())]
        return spark.createDataFrame(rows, "event_type string, version int, description string, registered_at long")

    def upcast(self, log: DataFrame) -> DataFrame:
        """The log with data and ``schema_version`` brought to the registered version, in one projection.

        Unregistered types and events at or above the version stay as they are.  A missing step
        is passed over and does not raise the version; steps after it still apply.
        Null metadata means version 1 and becomes a map only if a step applies.

        The type decides first, so a row meets the steps of its own type only; data is parsed
        once for all field steps in a row, and the plan grows in proportion to the steps.
        Types with the same steps share a branch.
        """
        # A column of its own: inside a lambda the name of a column made in the same projection would mean the new one.
        log, start = log.withColumn("__start", version_of(F.col("metadata"))), F.col("__start")
        data, version = F.col("data"), start
        for types, steps in self._grouped(lambda s: tuple((v, s.upcast_from[v]) for v in range(1, s.version) if v in s.upcast_from)):
            last = steps[-1][0]
            # The start version decides which steps run, not the version reached so far.
            run = F.col("event_type").isin(types) & (start <= last)
            data = F.when(run, _chain(list(steps), F.col("data"), start)).otherwise(data)
            version = F.when(run, F.lit(last + 1)).otherwise(version)
        changed = version != start
        other = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != VERSION_KEY)
        metadata = F.when(changed, F.map_concat(other, F.create_map(F.lit(VERSION_KEY), version.cast("string")))).otherwise(F.col("metadata"))
        return log.withColumns({"data": data, "metadata": metadata}).drop("__start")

    def _grouped(self, of: Callable) -> list[tuple[list[str], tuple]]:
        """The registered types by what ``of`` gives for their schema, without those it gives nothing for."""
        groups: dict = {}
        for event_type, s in sorted(self._schemas.items()):
            if key := of(s):
                groups.setdefault(key, []).append(event_type)
        return [(types, key) for key, types in groups.items()]

    def validated(self, log: DataFrame) -> DataFrame:
        """The log with ``valid``: the validator's verdict, true without one; a null verdict is false."""
        verdict = F.lit(True)
        for types, (validator,) in self._grouped(lambda s: (s.validator,) if s.validator is not None else ()):
            verdict = F.when(F.col("event_type").isin(types), F.coalesce(validator(F.col("data")), F.lit(False))).otherwise(verdict)
        return log.withColumn("valid", F.coalesce(verdict, F.lit(True)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated, and written into the plan, once."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class FieldStep:
    """A step on the fields of JSON object text, given as an edit of their map; data that is no object stays as it is."""

    edit: Callable[[Column], Column]

    def __call__(self, data: Column) -> Column:
        return _text(_let(_fields(data), self.edit), data)


def _chain(steps: list[tuple[int, Callable]], data: Column, start: Column) -> Column:
    """Data after those of the ascending steps that are at or above the start version."""
    if not steps:
        return data
    if isinstance(steps[0][1], FieldStep):
        n = next((i for i, (_, f) in enumerate(steps) if not isinstance(f, FieldStep)), len(steps))
        done = F.when(start <= steps[n - 1][0], _text(_let(_fields(data), lambda m: _edits(steps[:n], m, start)), data)).otherwise(data)
    else:
        n, (v, f) = 1, steps[0]
        done = F.when(start <= v, f(data)).otherwise(data)
    return done if n == len(steps) else _let(done, lambda d: _chain(steps[n:], d, start))


def _edits(steps: list[tuple[int, FieldStep]], fields: Column, start: Column) -> Column:
    (v, f), rest = steps[0], steps[1:]
    done = F.when(start <= v, f.edit(fields)).otherwise(fields)
    return _let(done, lambda m: _edits(rest, m, start)) if rest else done


def version_of(metadata: Column) -> Column:
    """The event's schema version: a positive whole number in the metadata, else 1."""
    v = metadata[VERSION_KEY].try_cast("int")
    return F.when(v > 0, v).otherwise(F.lit(1))


def schema_state(log: DataFrame, schemas: DataFrame) -> DataFrame:
    """The log's events with their version, the registered one and a state: unregistered, behind, current or newer.

    ``schemas`` has one row per type; of several the largest version counts.
    """
    known = schemas.groupBy(F.col("event_type").alias("s_type")).agg(F.max("version").alias("registered"))
    v = version_of(F.col("metadata"))
    state = F.when(F.col("registered").isNull(), "unregistered").when(v < F.col("registered"), "behind").when(v == F.col("registered"), "current").otherwise("newer")
    return log.join(known, F.col("event_type") == F.col("s_type"), "left").drop("s_type").withColumn("event_version", v).withColumn("state", state)


# Steps that schemas are often made of, on JSON text.
def add_field(name: str, json_value: str) -> FieldStep:
    """Set a field that is missing."""
    return FieldStep(lambda m: F.when(F.map_contains_key(m, F.lit(name)), m).otherwise(F.map_concat(m, F.create_map(F.lit(name), F.parse_json(F.lit(json_value))))))


def rename_field(old: str, new: str) -> FieldStep:
    def edit(m: Column) -> Column:
        rest = F.map_filter(m, lambda k, _: (k != old) & (k != new))
        return F.when(F.map_contains_key(m, F.lit(old)), F.map_concat(rest, F.create_map(F.lit(new), m[old]))).otherwise(m)

    return FieldStep(edit)


def nest_fields(names: list[str], into: str) -> FieldStep:
    """Move fields into an object of its own."""

    def edit(m: Column) -> Column:
        rest = F.map_filter(m, lambda k, _: ~k.isin([*names, into]))
        inner = F.map_filter(m, lambda k, _: k.isin(names))
        moved = F.map_concat(rest, F.create_map(F.lit(into), F.parse_json(F.to_json(inner))))
        return F.when(F.size(inner) > 0, moved).otherwise(m)

    return FieldStep(edit)


def _fields(data: Column) -> Column:
    return F.try_parse_json(data).try_cast("map<string,variant>")


def _text(fields: Column, data: Column) -> Column:
    """JSON text with fields in name order; data that is no object stays as it is."""
    sorted_fields = F.map_from_entries(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))))
    entries = F.transform(F.map_entries(sorted_fields), lambda e: F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), e["value"]))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")), data)
