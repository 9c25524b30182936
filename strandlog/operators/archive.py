"""Archives of event ranges: keys, and a backend that keeps them as Parquet folders."""

from __future__ import annotations

import json
import re
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.runtime import create_exclusive, delete_path, full_uri, list_names, path_exists, read_text

SUFFIX = ".archive"


class ArchiveNotFound(LookupError):
    pass


class CorruptedArchive(ValueError):
    pass


def make_key(store: str, stream: str, first: int, last: int) -> str:
    return f"{store}/{stream}/{first}-{last}{SUFFIX}"


def parse_key(key: str) -> tuple[str, str, int, int]:
    """(store, stream, first, last).  Only a key of exactly three parts is one, so a stream id has no slash."""
    m = re.fullmatch(r"([^/]*)/([^/]*)/(\d+)-(\d+)" + re.escape(SUFFIX), key)
    if not m:
        raise ValueError(f"not an archive key: {key}")
    return m[1], m[2], int(m[3]), int(m[4])


def key_column(store: str, stream: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit(store + "/"), stream, F.lit("/"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(SUFFIX))


def parsed_key(key: Column) -> Column:
    """struct(store, stream, first, last), null where the text is no key."""
    e = r"^([^/]*)/([^/]*)/([0-9]+)-([0-9]+)\.archive$"
    part = lambda i: F.regexp_extract(key, e, i)
    return F.when(key.rlike(e), F.struct(part(1).alias("store"), part(2).alias("stream"), part(3).cast("long").alias("first"), part(4).cast("long").alias("last")))


class ArchiveBackend(ABC):
    """Where archives are kept.  Keys are texts made by ``make_key``."""

    @abstractmethod
    def archive(self, key: str, events: DataFrame) -> int: ...

    @abstractmethod
    def read(self, key: str) -> DataFrame: ...

    @abstractmethod
    def list(self, store: str, stream: str) -> list[str]: ...

    @abstractmethod
    def delete(self, key: str) -> None: ...

    @abstractmethod
    def exists(self, key: str) -> bool: ...


class FolderArchive(ArchiveBackend):
    """Archives under ``base_dir``: zstd Parquet sorted by version, valid once its description is written."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark, self.base_dir = spark, full_uri(spark, base_dir).rstrip("/")

    def _path(self, key: str) -> str:
        parse_key(key)
        return f"{self.base_dir}/{key}"

    def archive(self, key: str, events: DataFrame) -> int:
        """Write the events; returns how many.  An archive that exists is replaced."""
        path, folder = self._path(key), f"events-{uuid.uuid4().hex}"
        old = self.describe(key)["folder"] if self.exists(key) else None
        events.repartitionByRange("version").sortWithinPartitions("version").write.option("compression", "zstd").parquet(f"{path}/{folder}")
        n = self.spark.read.parquet(f"{path}/{folder}").count()
        created = self.spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0]
        # The events are whole before the description names them; the old ones go last.
        delete_path(self.spark, f"{path}/about.json")
        create_exclusive(self.spark, f"{path}/about.json", json.dumps({"version": 1, "created_at": created, "event_count": n, "folder": folder}))
        if old is not None:
            delete_path(self.spark, f"{path}/{old}")
        return n

    def describe(self, key: str) -> dict:
        path = self._path(key)
        if not path_exists(self.spark, path):
            raise ArchiveNotFound(key)
        try:
            return json.loads(read_text(self.spark, f"{path}/about.json"))
        except Exception as e:
            raise CorruptedArchive(key) from e

    def read(self, key: str) -> DataFrame:
        about = self.describe(key)
        try:
            events = self.spark.read.parquet(f"{self._path(key)}/{about['folder']}")
            n = events.count()
        except Exception as e:
            raise CorruptedArchive(key) from e
        if n != about["event_count"]:
            raise CorruptedArchive(f"{key}: {n} of {about['event_count']} events")
        return events.orderBy("version")

    def list(self, store: str, stream: str) -> list[str]:
        found = [n for n in list_names(self.spark, f"{self.base_dir}/{store}/{stream}") if n.endswith(SUFFIX)]
        return sorted((f"{store}/{stream}/{n}" for n in found), key=lambda k: parse_key(k)[2:])

    def delete(self, key: str) -> None:
        """Deleting what is not there is no error."""
        delete_path(self.spark, self._path(key))

    def exists(self, key: str) -> bool:
        return path_exists(self.spark, f"{self._path(key)}/about.json")
