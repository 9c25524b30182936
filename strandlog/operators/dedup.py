"""Exactly one row of each repeatedly delivered message, kept up to date batch by batch."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.runtime import create_exclusive, delete_path, fields, full_uri, list_names, read_text

_ROW = "prefix int, hash long, id string, time long, row long"
_LOCAL = fields(_ROW + ", lost boolean")
_RESULT = fields("row long, prefix int, file string")
#: Ids that a task's bucket is meant to hold, and the least number of hash bits that tell buckets.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 1 << 20, 5, 24


@dataclass(frozen=True)
class Run:
    """An immutable run: one file of sorted arrays per bucket of the first ``bits`` bits of the hash."""

    name: str
    bits: int
    rows: int
    files: dict[int, str]


def _repeats(ids):
    """For an Arrow array in which equal ids are neighbours: True where an id equals the one before."""
    import numpy as np
    import pyarrow.compute as pc

    again = np.zeros(len(ids), bool)
    if len(ids) > 1:
        again[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
    return again


def _local_best(batches):
    """Before any exchange, one best row per id of each Arrow batch; the others are lost for good."""
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            t = pa.table(b).sort_by([(c, "ascending") for c in ("hash", "id", "time", "row")])
            yield from t.append_column("lost", pa.array(_repeats(t.column("id").combine_chunks()))).to_batches()


def _buckets(batches):
    """(prefix, table) of each run of equal prefixes in a task's sorted rows."""
    import numpy as np
    import pyarrow as pa

    held, prefix = [], None
    for b in batches:
        t = pa.table(b)
        p = t.column("prefix").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if held and int(p[a]) != prefix:
                yield prefix, pa.concat_tables(held)
                held = []
            prefix = int(p[a])
            held.append(t.slice(a, z - a))
    if held:
        yield prefix, pa.concat_tables(held)


def _read_run(root: str, run: Run, prefix: int, bits: int):
    """The sorted arrays of a run with this prefix of ``bits`` bits, or None; mapped, not read, where the folder is a mounted one.

    A run that was cut by fewer bits has them as a stretch of a larger bucket.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.ipc as ipc
    from pyarrow import fs

    name = run.files.get(prefix >> (bits - run.bits))
    if name is None:
        return None
    system, path = fs.FileSystem.from_uri(f"{root}/{run.name}/{name}")
    source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
    t = ipc.open_file(source).read_all().combine_chunks()
    if run.bits < bits:
        # All hashes of a bucket have the same first bit, so they are in the same order with and without sign.
        low = prefix << (64 - bits)
        first = low - (1 << 64) if low >> 63 else low
        h = t.column("hash").to_numpy()
        a, z = np.searchsorted(h, np.int64(first), "left"), np.searchsorted(h, np.int64(first + (1 << (64 - bits)) - 1), "right")
        t = t.slice(a, z - a).combine_chunks()
    return t


def _write_run(folder: str, prefix: int, table) -> str:
    """Write a bucket's sorted arrays under a name that no other attempt of the task uses."""
    import uuid

    import pyarrow.ipc as ipc
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"p{prefix:06d}-{uuid.uuid4().hex}.arrow"
    with system.open_output_stream(f"{path}/{name}") as out, ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    return name


def _lookup(old, h, ids, waiting):
    """Row of ``old`` (sorted by hash) with each waiting id, or -1, by binary search on the hash."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    oh, oid = old.column("hash").combine_chunks().to_numpy(), old.column("id").combine_chunks()
    at, end = np.searchsorted(oh, h[waiting], "left"), np.searchsorted(oh, h[waiting], "right")
    match = np.full(len(waiting), -1)
    there = np.flatnonzero(at < end)
    if len(there):
        same = pc.equal(oid.take(pa.array(at[there])), ids.take(pa.array(waiting[there]))).to_numpy(zero_copy_only=False)
        match[there[same]] = at[there[same]]
        for j in there[~same]:  # another id has the same 64-bit hash
            match[j] = next((p for p in range(at[j] + 1, end[j]) if oid[p] == ids[int(waiting[j])]), -1)
    return match


def _probe(root: str, runs: list[Run], bits: int, folder: str):
    """The task that brings incoming buckets and the index together; ``runs`` oldest first."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def losers(rows):
            n = len(rows)
            return pa.record_batch([pa.array(rows, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=["row", "prefix", "file"])

        for prefix, new in _buckets(batches):
            row = new.column("row").to_numpy()
            if prefix < 0:  # lost before the exchange
                yield losers(row)
                continue
            new = new.combine_chunks()
            ids, h, time = new.column("id").combine_chunks(), new.column("hash").to_numpy(), new.column("time").to_numpy()
            lost = _repeats(ids)
            waiting = np.flatnonzero(~lost)
            for run in reversed(runs):
                old = _read_run(root, run, prefix, bits) if len(waiting) else None
                if old is not None:
                    match = _lookup(old, h, ids, waiting)
                    hit = match >= 0
                    w, p = waiting[hit], match[hit]
                    ot, orow = old.column("time").to_numpy()[p], old.column("row").to_numpy()[p]
                    worse = (time[w] > ot) | ((time[w] == ot) & (row[w] >= orow))
                    lost[w[worse]] = True
                    yield losers(orow[~worse])  # stayed so far, now beaten
                    waiting = waiting[~hit]
            yield losers(row[lost])
            keep = new.filter(pa.array(~lost)).select(["hash", "id", "time", "row"])
            if keep.num_rows:
                name = _write_run(folder, prefix, keep)
                yield pa.record_batch([pa.array([keep.num_rows], pa.int64()), pa.array([prefix], pa.int32()), pa.array([name])], names=["row", "prefix", "file"])

    return work


def _merged(root: str, runs: list[Run], prefix: int, bits: int):
    """All runs of one bucket as one sorted table, or None; of an id the newest run's row holds.

    The stable sort of arrays that are sorted runs already is a merge of these runs.
    """
    import numpy as np
    import pyarrow as pa

    parts = [t for run in reversed(runs) if (t := _read_run(root, run, prefix, bits)) is not None and t.num_rows]
    if not parts:
        return None
    t = pa.concat_tables(parts)
    t = t.take(pa.array(np.argsort(t.column("hash").to_numpy(), kind="stable"))).combine_chunks()
    h, ids = t.column("hash").to_numpy(), t.column("id").combine_chunks()
    again = _repeats(ids)
    mixed = np.flatnonzero((h[1:] == h[:-1]) & ~again[1:])
    for value in np.unique(h[mixed]):  # several ids with one 64-bit hash: their copies need not be neighbours
        seen = set()
        for i in range(np.searchsorted(h, value, "left"), np.searchsorted(h, value, "right")):
            again[i] = ids[i] in seen
            seen.add(ids[i])
    return t.filter(pa.array(~again)).combine_chunks()


def _merge(root: str, runs: list[Run], bits: int, folder: str):
    """The task that merges all runs of its buckets; of an id the newest run's row holds."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            for prefix in b.column("prefix").to_pylist():
                keep = _merged(root, runs, prefix, bits)
                if keep is not None:
                    name = _write_run(folder, prefix, keep)
                    yield pa.record_batch([pa.array([keep.num_rows], pa.int64()), pa.array([prefix], pa.int32()), pa.array([name])], names=["row", "prefix", "file"])

    return work


def _scan(root: str, runs: list[Run], bits: int):
    """The task that reads the merged content of its buckets."""

    def work(batches):
        for b in batches:
            for prefix in b.column("prefix").to_pylist():
                keep = _merged(root, runs, prefix, bits)
                if keep is not None:
                    yield from keep.select(["id", "row"]).to_batches()

    return work


class DeliveryIndex:
    """A persisted index of delivered ids: immutable runs of arrays sorted by hash, one file per hash prefix.

    ``apply`` takes a batch of rows and returns those that are not to stay: repeats within
    the batch, rows that lose against the index, and rows that stayed so far and lose now.
    Of the rows of one id the one with the smallest (time, row) stays, whatever the batches
    and their order.  A batch is cut by hash prefix; a task maps the run files of its
    prefixes and looks incoming ids up by binary search, so the index itself is never moved.
    Each batch adds one run; more than ``max_runs`` are merged into one.

    Rows with a null id are no repeats and are left alone.  A null time comes last.  ``row``
    must be unique and not null; a row given again changes nothing and is reported lost.

    A run counts once the manifest names it; files of failed attempts are never named, so a
    batch that fails leaves the index as it was and can be given again.

    The bits of the hash that tell buckets follow the size: so many that a bucket holds about
    ``bucket_rows`` ids of the index and the batch (``expected_rows``, where it is given,
    saves counting).  A run keeps the bits it was written with; a task that works with more
    takes its stretch of the run's larger bucket, and merging writes with the new number.
    """

    NO_TIME = 2**63 - 1

    def __init__(self, spark: SparkSession, path: str, max_runs: int = 8, bucket_rows: int = BUCKET_ROWS, expected_rows: int | None = None):
        self.spark, self.max_runs, self.bucket_rows, self.expected_rows = spark, max_runs, bucket_rows, expected_rows
        self.path = full_uri(spark, path).rstrip("/")
        names = list_names(spark, f"{self.path}/manifest")
        last = json.loads(read_text(spark, f"{self.path}/manifest/{names[-1]}")) if names else {"runs": []}
        self.at = len(names)
        self.runs = [Run(name, bits, rows, {int(k): v for k, v in files.items()}) for name, bits, rows, files in last["runs"]]

    def _commit(self, runs: list[Run]) -> None:
        text = json.dumps({"runs": [[r.name, r.bits, r.rows, r.files] for r in runs]})
        if not create_exclusive(self.spark, f"{self.path}/manifest/{self.at:09d}.json", text):
            raise RuntimeError("another writer changed the index; open it again")
        self.at, self.runs = self.at + 1, runs

    def _bits(self, rows: int = 0) -> int:
        """Bits for the index and ``rows`` more, never fewer than a run has."""
        held = max(sum(r.rows for r in self.runs) + rows, self.expected_rows or 0)
        needed = (-(-held // self.bucket_rows) - 1).bit_length() if held else 0
        return max([min(max(needed, LEAST_BITS), MOST_BITS), *(r.bits for r in self.runs)])

    def _run_of(self, name: str, bits: int, results: DataFrame) -> Run:
        found = results.where(F.col("file").isNotNull()).select("prefix", "file", "row").collect()  # one row per bucket
        return Run(name, bits, sum(r.row for r in found), {r.prefix: r.file for r in found})

    def apply(self, batch: DataFrame, id_col: str, time_col: str, row_col: str) -> DataFrame:
        """Add a batch; returns ``row`` of each row that is not to stay (stored with the run)."""
        hashed = F.xxhash64("id")
        narrow = batch.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(time_col).cast("long"), F.lit(self.NO_TIME)).alias("time"), F.col(row_col).cast("long").alias("row")
        )
        bits = self._bits(0 if self.expected_rows else batch.count())
        narrow = narrow.select(F.shiftrightunsigned(hashed, 64 - bits).cast("int").alias("prefix"), hashed.alias("hash"), "id", "time", "row")
        local = narrow.mapInArrow(_local_best, _LOCAL)
        # What is lost already only passes, spread evenly: copies of one message may be a third of all rows.
        passed = -1 - F.pmod(F.col("row"), F.lit(1 << bits)).cast("int")
        moved = local.select(F.when(F.col("lost"), passed).otherwise(F.col("prefix")).alias("prefix"), "hash", F.when(~F.col("lost"), F.col("id")).alias("id"), "time", "row")
        name = f"run-{uuid.uuid4().hex}"
        folder = f"{self.path}/{name}"
        sorted_rows = moved.repartition("prefix").sortWithinPartitions("prefix", "hash", "id", "time", "row")
        sorted_rows.mapInArrow(_probe(self.path, self.runs, bits, folder), _RESULT).write.parquet(f"{folder}/results")
        results = self.spark.read.schema(_RESULT).parquet(f"{folder}/results")
        self._commit([*self.runs, self._run_of(name, bits, results)])
        if len(self.runs) > self.max_runs:
            self.compact()
        return results.where(F.col("file").isNull()).select("row")

    def _each_prefix(self, bits: int, work, schema) -> DataFrame:
        tasks = min(1 << bits, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self.spark.range(0, 1 << bits, 1, tasks).select(F.col("id").cast("int").alias("prefix")).mapInArrow(work, schema)

    def compact(self) -> None:
        """Merge all runs into one.  Files of the old runs go once the manifest names the new run."""
        if len(self.runs) < 2:
            return
        old, name, bits = self.runs, f"run-{uuid.uuid4().hex}", self._bits()
        folder = f"{self.path}/{name}"
        self._each_prefix(bits, _merge(self.path, old, bits, folder), _RESULT).write.parquet(f"{folder}/results")
        self._commit([self._run_of(name, bits, self.spark.read.schema(_RESULT).parquet(f"{folder}/results"))])
        for run in old:
            for f in run.files.values():
                delete_path(self.spark, f"{self.path}/{run.name}/{f}")

    def kept(self) -> DataFrame:
        """``id, row`` of the row that stays of each id after all batches so far."""
        bits = self._bits()
        return self._each_prefix(bits, _scan(self.path, self.runs, bits), "id string, row long")


def duplicate_rows(df: DataFrame, id_col: str, time_col: str, row_col: str, batch_col: str, index_path: str, rounds: int = 4, bucket_rows: int = BUCKET_ROWS, max_runs: int = 2) -> DataFrame:
    """Rows of a log that are not to stay, taking its batches in order through a new index.

    The log's batches are taken in ``rounds`` groups of neighbouring batch numbers (a null
    batch number goes with the first), as a consumer that runs now and then would; more than
    ``max_runs`` runs of the index are merged on the way.  The result does not depend on
    either.
    """
    spark = df.sparkSession
    span = df.agg(F.min(batch_col).alias("a"), F.max(batch_col).alias("z"), F.count(F.lit(1)).alias("n")).first()
    index = DeliveryIndex(spark, index_path, max_runs, bucket_rows, span.n)
    if span.a is None:
        return index.apply(df, id_col, time_col, row_col)
    width = (span.z - span.a) // rounds + 1
    out = None
    for i in range(rounds):
        low = span.a + i * width
        if low > span.z:
            break
        part = F.col(batch_col).between(low, low + width - 1)
        lost = index.apply(df.where(part | F.col(batch_col).isNull() if i == 0 else part), id_col, time_col, row_col)
        out = lost if out is None else out.union(lost)
    return out
