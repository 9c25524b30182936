"""Settings of a store, from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

MODES = ("single", "cluster")


@dataclass(frozen=True)
class StoreConfig:
    """``buckets`` and ``max_files_per_trigger`` take the place of worker pools and timeouts in a Spark engine."""

    name: str
    path: str
    mode: str = "single"
    buckets: int | None = None
    max_files_per_trigger: int | None = None

    @classmethod
    def of(cls, name: str, settings: Mapping[str, str], prefix: str = "STORE_") -> StoreConfig:
        """Read ``<prefix>PATH``, ``MODE``, ``BUCKETS`` and ``MAX_FILES``; an unknown mode means single."""
        mode = settings.get(prefix + "MODE", "single")
        number = lambda k: int(settings[prefix + k]) if settings.get(prefix + k) else None
        return cls(name, settings.get(prefix + "PATH", f"{name}-data"), mode if mode in MODES else "single", number("BUCKETS"), number("MAX_FILES"))
