"""Subscriptions: which events a subscriber gets, the registry, and acknowledged positions."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.text import wildcard_match
from strandlog.operators.fold import NUMBER, data_fields
from strandlog.shared_state import SharedState

TYPES = ("stream", "event_type", "event_pattern", "event_payload")
EVERY_STREAM = "$all"
_COMPARE = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}


class AlreadyExists(ValueError):
    pass


def by_stream(stream: str) -> Column:
    """One stream by its full id, or every stream for ``$all``."""
    return F.lit(True) if stream == EVERY_STREAM else F.col("stream_id") == stream


def by_event_type(event_type: str) -> Column:
    return F.col("event_type") == event_type


def by_event_pattern(pattern: dict[str, str | int | None] | str) -> Column:
    """Every given field of the event equals its value; a text is a ``*`` pattern on the stream id."""
    if isinstance(pattern, str):
        return wildcard_match(F.col("stream_id"), pattern, question_literal=True)
    out = F.lit(True)
    for name, value in pattern.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def by_event_payload(pattern: dict) -> Column:
    """Every given field of the data equals its value, or compares with it: ``{"amount": {"gt": 10}}``.

    Comparisons are gt, gte, lt, lte (numbers), ne and in.  A field that is missing matches
    nothing but ne; text and numbers are never equal.
    """
    fields = data_fields(F.col("data"))
    out = F.lit(True)
    for name, want in pattern.items():
        text = F.to_json(fields[name])
        number = F.when(F.schema_of_variant(fields[name]).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), fields[name].try_cast(NUMBER))
        same = lambda v: text == json.dumps(v, ensure_ascii=False, separators=(",", ":"))  # noqa: E731, B023
        if isinstance(want, dict) and want and set(want) <= {*_COMPARE, "ne", "in"}:
            for op, v in want.items():
                if op == "ne":
                    hit = ~F.coalesce(same(v), F.lit(False))
                elif op == "in":
                    hit = text.isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in v])
                else:
                    hit = _COMPARE[op](number, F.lit(str(v)).cast(NUMBER))
                out = out & F.coalesce(hit, F.lit(False))
        else:
            out = out & F.coalesce(same(want), F.lit(False))
    return out


def predicate(kind: str, selector) -> Column:
    if kind not in TYPES:
        raise ValueError(f"type is one of {TYPES}")
    if kind in ("event_pattern", "event_payload") and isinstance(selector, str) and selector.lstrip().startswith("{"):
        selector = json.loads(selector)
    if kind == "event_payload" and not isinstance(selector, dict):
        raise ValueError("a payload selector is a map")
    return {"stream": by_stream, "event_type": by_event_type, "event_pattern": by_event_pattern, "event_payload": by_event_payload}[kind](selector)


def matching(log: DataFrame, kind: str, selector) -> DataFrame:
    """The events a subscription gets; a null verdict is no."""
    return log.where(predicate(kind, selector))


def key_of(kind: str, selector, name: str) -> str:
    """The subscription's key: one text per (type, selector, name)."""
    return hashlib.sha256(json.dumps([kind, selector, name], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Subscription:
    id: str
    type: str
    selector: object
    name: str
    created_at: int
    pool_size: int = 1
    checkpoint: int | None = None
    subscriber: str | None = None
    options: dict[str, str] = field(default_factory=dict)


class SubscriptionRegistry:
    """Definitions by key, durable if a folder is given; listeners of this object are told of its changes."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self._state = SharedState(spark, path)
        self._listeners: list = []

    def setup_tracking(self, listener) -> None:
        """``listener(what, subscription)`` is called with created, updated or deleted."""
        self._listeners.append(listener)

    def _tell(self, what: str, sub: Subscription) -> Subscription:
        for f in self._listeners:
            f(what, sub)
        return sub

    def subscribe(self, kind: str, selector, name: str, pool_size: int = 1, start_from: int | None = None, subscriber: str | None = None, options: dict[str, str] | None = None) -> str:
        predicate(kind, selector)
        key = key_of(kind, selector, name)
        sub = Subscription(key, kind, selector, name, time.time_ns() // 1_000_000, pool_size, start_from, subscriber, options or {})

        def add(subs: dict) -> None:
            if key in subs:
                raise AlreadyExists(name)
            subs[key] = sub

        self._state.change(add)
        self._tell("created", sub)
        return key

    def unsubscribe(self, key: str | None = None, kind: str | None = None, name: str | None = None) -> None:
        """By key, or the first of a type and name; LookupError if there is none."""

        def remove(subs: dict) -> Subscription:
            k = key if key is not None else next((k for k, s in sorted(subs.items()) if s.type == kind and s.name == name), None)
            if k not in subs:
                raise LookupError("not_found")
            return subs.pop(k)

        self._tell("deleted", self._state.change(remove))

    def get(self, key: str) -> Subscription:
        return self._state.read()[key]

    def exists(self, key: str) -> bool:
        return key in self._state.read()

    def list(self) -> list[Subscription]:
        return [s for _, s in sorted(self._state.read().items())]

    def find_by_name(self, name: str) -> Subscription:
        found = [s for s in self.list() if s.name == name]
        if not found:
            raise LookupError("not_found")
        return found[0]

    def update(self, key: str, **new) -> Subscription:
        """Replace fields of a subscription; LookupError if there is none."""

        def put(subs: dict) -> Subscription:
            if key not in subs:
                raise LookupError("not_found")
            subs[key] = replace(subs[key], **new)
            return subs[key]

        return self._tell("updated", self._state.change(put))

    def ack(self, name: str, checkpoint: int) -> Subscription:
        """Set the checkpoint of the first subscription of that name; it may also go back."""
        return self.update(self.find_by_name(name).id, checkpoint=checkpoint)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.id, s.type, s.selector if isinstance(s.selector, str) else json.dumps(s.selector), s.name, s.subscriber, s.created_at, s.pool_size, s.checkpoint, s.options) for s in self.list()]
        return spark.createDataFrame(rows, "id string, selector_type string, selector string, subscription_name string, subscriber_pid string, created_at long, pool_size int, checkpoint long, options map<string,string>")


def subscription_counts(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``id, events, last_version`` that each stored subscription matches, all in one pass over the log.

    ``subscriptions`` has ``id, selector_type, selector``: a small table of definitions whose
    predicates become one expression.  Unreadable selectors match nothing.
    """
    subs = subscriptions.select("id", "selector_type", "selector").collect()
    tests = []
    for s in subs:
        try:
            p = predicate(s.selector_type, s.selector)
        except (ValueError, TypeError):
            p = F.lit(False)
        tests.append(F.when(F.coalesce(p, F.lit(False)), F.lit(s.id)))
    zero = F.lit(0).cast("long")
    if not tests:
        return subscriptions.select("id", zero.alias("events"), F.lit(None).cast("long").alias("last_version"))
    hit = log.select("version", F.explode(F.array_compact(F.array(*tests))).alias("f_id")).groupBy("f_id").agg(F.count(F.lit(1)).alias("events"), F.max("version").alias("last_version"))
    return subscriptions.select("id").join(hit, F.col("id") == F.col("f_id"), "left").select("id", F.coalesce("events", zero).alias("events"), "last_version")


def emitter_of(event_id: Column, pool_size: Column | int) -> Column:
    """Which of the pool's workers an event goes to: one, the same at every delivery."""
    return F.pmod(F.xxhash64(event_id), (F.lit(pool_size) if isinstance(pool_size, int) else pool_size).cast("long"))
