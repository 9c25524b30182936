"""What several operators need from the running session: a shared folder, written
intermediate tables, and the few keys that hold a large share of a table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARED_DIR_SETTING = "spark.checkpoint.dir"


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "double": T.DoubleType(),
    "array<int>": T.ArrayType(T.IntegerType()), "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def fields(text: str) -> T.StructType:
    """A schema from ``"name type, ..."`` without a running session, so that modules can hold schemas."""
    pairs = [part.strip().split(" ", 1) for part in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent and the session is local (tests), a temporary folder is
    made, set as the session's checkpoint folder and removed at exit.  On a cluster the
    setting is required: a folder of one machine would lose data with that machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(SHARED_DIR_SETTING) or spark.conf.get(SHARED_DIR_SETTING, None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR_SETTING} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="strandlog-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir("file://" + own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any file system Hadoop knows; a missing one is no error."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Unlike blocks kept on executors they survive the loss of any executor.  Each table
    keeps its name only inside this object; ``drop`` removes one, ``release`` all.
    What is left is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.release)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, merge: str | None = None) -> DataFrame:
        """Write ``df`` and return the table as read back, with the schema it was given.

        Loops need ``merge``: what is joined with all that was written before has as many tasks
        as those tables together, and would leave as many files.  "rebalance" moves the rows
        into files of a sensible size; "coalesce" lets a task do the work of several and moves
        nothing, for wide rows.
        """
        schema = df.schema
        if merge == "rebalance":
            df = df.hint("rebalance")
        elif merge == "coalesce":
            df = df.coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))

    def release(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the JVM may be gone already at exit
            pass


def key_hash(*keys: str | Column) -> Column:
    """A 64-bit hash that tells rows of heavy keys; two keys with one hash are only both spread."""
    return F.xxhash64(*keys)


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> tuple[int, list[int]]:
    """Number of rows, and ``key_hash`` of each key that holds at least ``share`` of them.

    One pass with a frequent-items sketch: a task keeps a bounded table of candidates and
    sends nothing else, so neither the number of keys nor a hot key matters.  The sketch holds
    16 / share items; its error is then below a fifth of the limit and counts are upper
    bounds, so no heavy key is missed.  A key just below the limit may be named too, which
    changes how work is spread and never a result.
    """
    total, (heavy,) = heavy_keys_of_each(df, [keys], share)
    return total, heavy


def heavy_keys_of_each(df: DataFrame, key_sets: list[list[str]], share: float) -> tuple[int, list[list[int]]]:
    """As :func:`heavy_keys` for several keys in the same pass."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    wanted, tracked = int(1.25 / share) + 1, int(16 / share) + 1
    top = [F.call_function("approx_top_k", key_hash(*keys), F.lit(wanted), F.lit(tracked)).alias(f"top{i}") for i, keys in enumerate(key_sets)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *top).first()
    return r.n, [sorted(x["item"] for x in r[f"top{i}"] or [] if x["count"] >= share * r.n) for i in range(len(key_sets))]


def salt_for(heavy: list[int], hashed: Column, spread: Column, salts: int) -> Column:
    """0 for light keys; for heavy ones a number below ``salts`` drawn from ``spread``.

    ``spread`` is a hash of the row's own values, not a random number: a task that runs
    again after a lost executor gives each row the same salt.
    """
    if not heavy:
        return F.lit(0)
    return F.when(hashed.isin(heavy), F.pmod(spread, F.lit(salts)).cast("int")).otherwise(F.lit(0))


def block_of(column: str, width: int) -> Column:
    """Number of the block of ``width`` whole numbers that a long lies in, exact for any sign and size."""
    return F.expr(f"(`{column}` - pmod(`{column}`, {width}L)) div {width}L")


def join_to_unique(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, heavy: list[int], salts: int, spread: list[str]) -> DataFrame:
    """Join ``left`` to a ``right`` whose key is unique, spreading the left side's heavy keys.

    A heavy key's left rows go to ``salts`` tasks and its single right row is repeated
    once for each of them, so at most ``len(heavy) * salts`` rows are added.
    """
    if not heavy:
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    a = left.withColumn("__salt", salt_for(heavy, key_hash(left_key), F.xxhash64(*spread), salts))
    copies = F.when(key_hash(right_key).isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.withColumn("__salt_r", F.explode(copies))
    return a.join(b, (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__salt_r")), how).drop("__salt", "__salt_r")


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that must not exist yet; False if another writer was first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(where, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or fs.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; a missing folder has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, for libraries that open files on executors."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def running_by_slots(df: DataFrame, key: str, slot: str, order: list[Column | str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Running sums or maxima within ``key`` in ``order``, added as columns, with a hot key spread by slots.

    ``slot`` is a whole number that rises with the order (a block of it); ``values`` maps a new
    column to ("sum" or "max", input column).  A task sees one slot of a key; what came
    before the slot is carried from a running result over one row per slot.  Rows with equal
    order get the result of all of them.
    """
    fold = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy(key, slot).orderBy(*order)
    earlier = Window.partitionBy("__key").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = df.groupBy(F.col(key).alias("__key"), F.col(slot).alias("__slot")).agg(*[fold[k](c).alias(f"__{n}") for n, (k, c) in values.items()])
    carried = per_slot.select("__key", "__slot", *[fold[k](f"__{n}").over(earlier).alias(f"__before_{n}") for n, (k, _) in values.items()])
    out = df.withColumns({n: fold[k](c).over(inside) for n, (k, c) in values.items()})
    out = out.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col(slot) == F.col("__slot")))
    zero = F.lit(0)
    both = {n: (F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"__before_{n}"), zero)) if k == "sum" else F.greatest(F.col(n), F.col(f"__before_{n}")) for n, (k, _) in values.items()}
    return out.withColumns(both).select(*df.columns, *values)


def numbered_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the row's place (from 0) within its ``key`` by ``order``, whatever the size of a group.

    Rows are range-partitioned by key and order and written with their place in the
    partition; counts per partition make the places global, and the first place of a key is
    taken off.  ``order`` should decide between all rows of a key.
    """
    scratch = Scratch(df.sparkSession, "numbered")
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = scratch.write(rows.withColumn("__place", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("__place", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += n
    base = F.create_map(*starts)[part] if starts else F.lit(None).cast("long")
    rows = rows.withColumn("__place", base + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min("__place").alias("__first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col("__place") - F.col("__first")).select(*df.columns, name)
