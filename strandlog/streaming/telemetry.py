"""What happened and how long it took: handlers for engine events, and progress of streaming queries."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQueryListener

Handler = Callable[[tuple[str, ...], dict, dict], None]
log = logging.getLogger("strandlog")


class Telemetry:
    """Named handlers, each for a set of event names (tuples of text)."""

    def __init__(self):
        self._handlers: dict[str, tuple[set[tuple[str, ...]] | None, Handler]] = {}

    def attach(self, name: str, events: list[tuple[str, ...]] | None, handler: Handler) -> None:
        """``events`` None means all; a name attached twice is an error."""
        if name in self._handlers:
            raise ValueError(f"already attached: {name}")
        self._handlers[name] = (None if events is None else set(events), handler)

    def detach(self, name: str) -> None:
        self._handlers.pop(name, None)

    def attach_default_handler(self) -> None:
        self.attach("default", None, lambda e, m, meta: log.info("%s %s %s", ".".join(e), m, meta))

    def detach_default_handler(self) -> None:
        self.detach("default")

    def emit(self, event: tuple[str, ...], measurements: dict, metadata: dict | None = None) -> None:
        """A handler that fails is detached, so that it cannot stop the work it watches."""
        for name, (events, handler) in list(self._handlers.items()):
            if events is None or event in events:
                try:
                    handler(event, measurements, metadata or {})
                except Exception:
                    log.exception("handler %s failed and was detached", name)
                    self.detach(name)

    @contextmanager
    def span(self, event: tuple[str, ...], metadata: dict | None = None):
        """Emits (*event, "start") and then "stop" with the duration, or "exception"."""
        began = time.perf_counter_ns()
        self.emit((*event, "start"), {}, metadata)
        try:
            yield
        except BaseException as e:
            self.emit((*event, "exception"), {"duration_ns": time.perf_counter_ns() - began}, (metadata or {}) | {"error": repr(e)})
            raise
        self.emit((*event, "stop"), {"duration_ns": time.perf_counter_ns() - began}, metadata)


class ProgressListener(StreamingQueryListener):
    """Hands the life of streaming queries on to a ``Telemetry``."""

    def __init__(self, telemetry: Telemetry):
        self._telemetry = telemetry

    def onQueryStarted(self, event):
        self._telemetry.emit(("subscription", "started"), {}, {"name": event.name})

    def onQueryProgress(self, event):
        p = event.progress
        self._telemetry.emit(("subscription", "progress"), {"rows": p.numInputRows, "batch": p.batchId}, {"name": p.name})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._telemetry.emit(("subscription", "stopped"), {}, {"error": event.exception})
