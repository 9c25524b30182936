"""One façade over stores, subscriptions, links and schemas, for callers that address stores by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import causation, fold, links, snapshots, streams, subscriptions, temporal
from strandlog.operators.flow import MemoryLevels
from strandlog.operators.schema_registry import SchemaRegistry
from strandlog.store import Store, StoreCatalog


@dataclass
class StoreRegistry:
    """Which stores run on which nodes."""

    _nodes: dict[str, dict[str, dict]] = field(default_factory=dict)

    def announce(self, node: str, store: str, about: dict | None = None) -> None:
        self._nodes.setdefault(node, {})[store] = about or {}

    def unannounce(self, node: str, store: str) -> None:
        self._nodes.get(node, {}).pop(store, None)

    def node_left(self, node: str) -> None:
        self._nodes.pop(node, None)

    def stores(self) -> list[str]:
        return sorted({s for on in self._nodes.values() for s in on})

    def on_node(self, node: str) -> list[str]:
        return sorted(self._nodes.get(node, {}))

    def about(self, store: str) -> dict[str, dict]:
        """What each node said of the store."""
        return {n: on[store] for n, on in sorted(self._nodes.items()) if store in on}


class Gateway:
    """Calls by store name.  Expected versions follow the gateway's rules: "any", "stream_exists", 0 for an empty stream too."""

    def __init__(self, spark: SparkSession, catalog: StoreCatalog | None = None):
        self.spark, self.catalog = spark, catalog or StoreCatalog(spark)
        self.registry, self.memory = StoreRegistry(), MemoryLevels()
        self._subscriptions: dict[str, subscriptions.SubscriptionRegistry] = {}
        self._links: dict[str, links.LinkRegistry] = {}
        self._schemas: dict[str, SchemaRegistry] = {}

    def open(self, name: str, path: str, node: str = "driver") -> Store:
        self.registry.announce(node, name, {"path": path})
        return self.catalog.start(name, path)

    def close(self, name: str, node: str = "driver") -> None:
        self.registry.unannounce(node, name)
        self.catalog.stop(name)

    def list_stores(self) -> list[str]:
        return self.catalog.list()

    def _log(self, store: str) -> DataFrame:
        return self.catalog.get(store).log()

    def append_events(self, store: str, stream: str, events, expected: int | str | None = None) -> int:
        """Without ``expected`` the current version is taken as expected, so a writer in between is a conflict."""
        s = self.catalog.get(store)
        return s.append(stream, s.version(stream), events) if expected is None else s.append(stream, expected, events, gateway=True)

    def get_events(self, store: str, stream: str, start: int, count: int, direction: str = "forward") -> DataFrame:
        log = self._log(store)
        streams.require_stream(log, stream)
        return streams.read(log, stream, start, count, direction)

    def stream_forward(self, store: str, stream: str, start: int, count: int) -> DataFrame:
        return self.get_events(store, stream, start, count, "forward")

    def stream_backward(self, store: str, stream: str, start: int, count: int) -> DataFrame:
        return self.get_events(store, stream, start, count, "backward")

    def read_by_event_types(self, store: str, types: list[str], limit: int | None = None) -> DataFrame:
        return streams.read_by_event_types(self._log(store), types, limit)

    def read_by_tags(self, store: str, tags: list[str], match: str = "any", limit: int | None = None) -> DataFrame:
        return streams.read_by_tags(self._log(store), tags, match, limit)

    def read_until(self, store: str, stream: str, at: int, **options) -> DataFrame:
        return temporal.read_until(self._log(store), stream, at, **options)

    def read_range(self, store: str, stream: str, since: int, until: int, **options) -> DataFrame:
        return temporal.read_range(self._log(store), stream, since, until, **options)

    def version_at(self, store: str, stream: str, at: int) -> int:
        return temporal.version_at(self._log(store), stream, at)

    def get_version(self, store: str, stream: str) -> int:
        return self.catalog.get(store).version(stream)

    def stream_exists(self, store: str, stream: str) -> bool:
        return streams.exists(self._log(store), stream)

    def get_streams(self, store: str) -> DataFrame:
        return streams.list_streams(self._log(store))

    def delete_stream(self, store: str, stream: str) -> None:
        self.catalog.get(store).delete(stream)

    def state(self, store: str, stream: str) -> DataFrame:
        """The folded state of a stream from its latest snapshot on."""
        own = F.col("stream_id") == stream
        return fold.aggregate_state(self._log(store).where(own), self.catalog.get(store).snapshots().where(own))

    def record_snapshot(self, store: str, stream: str, version: int, data, metadata: dict | None = None) -> None:
        self.catalog.get(store).save_snapshot(stream, version, data, metadata)

    def read_snapshot(self, store: str, stream: str, version: int | None = None) -> DataFrame:
        saved = self.catalog.get(store).snapshots()
        return snapshots.load(saved, stream) if version is None else snapshots.load_at(saved, stream, version)

    def list_snapshots(self, store: str, stream: str) -> DataFrame:
        return snapshots.list_snapshots(self.catalog.get(store).snapshots(), stream)

    def get_effects(self, store: str, event_id: str) -> DataFrame:
        return causation.get_effects(self._log(store), event_id)

    def get_cause(self, store: str, event_id: str):
        return causation.get_cause(self._log(store), event_id)

    def get_chain(self, store: str, event_id: str) -> DataFrame:
        return causation.get_chain(self._log(store), event_id)

    def get_correlated(self, store: str, correlation_id: str) -> DataFrame:
        return causation.get_correlated(self._log(store), correlation_id)

    def build_graph(self, store: str, wanted: str):
        return causation.build_graph(self._log(store), wanted)

    def subscriptions(self, store: str) -> subscriptions.SubscriptionRegistry:
        return self._subscriptions.setdefault(store, subscriptions.SubscriptionRegistry())

    def links(self, store: str) -> links.LinkRegistry:
        return self._links.setdefault(store, links.LinkRegistry())

    def schemas(self, store: str) -> SchemaRegistry:
        return self._schemas.setdefault(store, SchemaRegistry())

    def upcast_events(self, store: str, events: DataFrame) -> DataFrame:
        return self.schemas(store).upcast(events)

    def get_memory_level(self) -> str:
        return self.memory.level

    def get_memory_stats(self) -> dict:
        """Bytes used, total and at most, and the level, of the driver's JVM."""
        r = self.spark._jvm.java.lang.Runtime.getRuntime()
        used, most = r.totalMemory() - r.freeMemory(), r.maxMemory()
        return {"used": used, "max": most, "share": used / most, "level": self.memory.check(used / most)}
