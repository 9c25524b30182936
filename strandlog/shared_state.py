"""Definitions that outlive their driver: a small dictionary under a folder."""

from __future__ import annotations

import base64
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from strandlog.runtime import create_exclusive, delete_path, full_uri, list_names, read_text

RETRIES, KEPT_FILES = 20, 20


class SharedState:
    """Values by key.  With a folder every change is a numbered file of the whole dictionary, created exclusively.

    Of two writers at once one is first and the other applies its change to the new state, so no
    change is lost and readers always see one whole state.  Values may hold functions and are
    pickled: use a folder that only trusted drivers can write to.  Without a folder the
    dictionary lives in this object.
    """

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self._own = spark, {}
        self.path = None if path is None else full_uri(spark, path).rstrip("/")

    def _load(self) -> tuple[int, dict[str, Any]]:
        names = list_names(self.spark, self.path)
        if not names:
            return 0, {}
        return int(names[-1]) + 1, cloudpickle.loads(base64.b64decode(read_text(self.spark, f"{self.path}/{names[-1]}")))

    def read(self) -> dict[str, Any]:
        return dict(self._own) if self.path is None else self._load()[1]

    def change(self, edit: Callable[[dict[str, Any]], Any]) -> Any:
        """Apply ``edit`` to the dictionary and keep it; returns what ``edit`` gives.  An error in it changes nothing."""
        if self.path is None:
            new = dict(self._own)
            result = edit(new)
            self._own = new
            return result
        for _ in range(RETRIES):
            number, state = self._load()
            result = edit(state)
            if create_exclusive(self.spark, f"{self.path}/{number:012d}", base64.b64encode(cloudpickle.dumps(state)).decode()):
                if number >= KEPT_FILES:
                    delete_path(self.spark, f"{self.path}/{number - KEPT_FILES:012d}")
                return result
        raise RuntimeError(f"no change after {RETRIES} tries")
