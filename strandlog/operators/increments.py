"""Only what no earlier run has taken for good: processed numbers as disjoint intervals."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.runtime import Scratch, block_of, create_exclusive, fields, full_uri, heavy_keys, join_to_unique, list_names, read_text, running_by_slots

#: Sequence numbers per block.  Work on a stream is split into blocks of this many numbers.
BLOCK = 4096
#: A stream with this share of all claims is spread when claims meet the streams' bounds.
HEAVY_SHARE, SALTS = 0.02, 16

_SEGMENT = fields("stream string, first long, last long, seen long")
_PENDING = fields("stream string, number long")


def cut_claims(claims: DataFrame, bounds: DataFrame, block: int = BLOCK) -> DataFrame:
    """Claims ``stream, first, last, seen`` cut at block edges, inside the numbers that exist.

    ``bounds`` has ``stream, low, high``, one row per stream.  A claim up to a huge last
    number costs no more pieces than its stream has blocks.  Repeated pieces are merged, the
    one with the largest ``seen`` standing for all; an empty or backward claim has none.
    """
    c = claims.where(F.col("stream").isNotNull() & F.col("first").isNotNull() & F.col("last").isNotNull() & F.col("seen").isNotNull())
    c = c.groupBy("stream", "first", "last").agg(F.max("seen").alias("seen"))
    b = bounds.select(F.col("stream").alias("b_stream"), "low", "high")
    _, heavy = heavy_keys(c, ["stream"], HEAVY_SHARE)
    c = join_to_unique(c, b, "stream", "b_stream", "inner", heavy, SALTS, ["first", "last"]).select("stream", F.greatest("first", "low").alias("first"), F.least("last", "high").alias("last"), "seen").where("first <= last")
    c = c.withColumn("block", F.explode(F.sequence(block_of("first", block), block_of("last", block))))
    return c.select(
        "stream", "block", F.greatest("first", F.col("block") * block).alias("first"), F.least("last", F.col("block") * block + (block - 1)).alias("last"), "seen"
    ).groupBy("stream", "block", "first", "last").agg(F.max("seen").alias("seen"))


def _segments(pieces: DataFrame) -> DataFrame:
    """``stream, block, first, last, seen``: pieces of :func:`cut_claims` as segments that do not overlap.

    The ends of a block's pieces, ranked, cut it into elementary segments (at most as many as
    it has numbers).  A piece marks those between its two ranks, the largest ``seen`` of a
    mark stands, and neighbours with one ``seen`` are joined.  All of it runs inside
    (stream, block), after one exchange.
    """
    here = ["stream", "block"]
    ends = pieces.select(*here, "first", "last", "seen", F.explode(F.array(F.col("first"), F.col("last") + 1)).alias("at"))
    ranked = ends.withColumn("rank", F.dense_rank().over(Window.partitionBy(*here).orderBy("at")))
    spans = ranked.groupBy(*here, "first", "last").agg(F.min("rank").alias("a"), F.max("rank").alias("z"), F.max("seen").alias("seen"))
    none = F.lit(None).cast("long")
    mark = lambda rank, at, seen: F.struct(rank.alias("rank"), at.cast("long").alias("at"), seen.cast("long").alias("seen"))
    marks = F.concat(
        F.transform(F.sequence(F.col("a"), F.col("z") - 1), lambda r: mark(r, none, F.col("seen"))),
        F.array(mark(F.col("a"), F.col("first"), none), mark(F.col("z"), F.col("last") + 1, none)),
    )
    cells = spans.select(*here, F.inline(marks)).groupBy(*here, "rank").agg(F.max("at").alias("first"), F.max("seen").alias("seen"))
    order = Window.partitionBy(*here).orderBy("rank")
    cells = cells.withColumn("last", F.lead("first").over(order) - 1).withColumn("new", ~F.col("seen").eqNullSafe(F.lag("seen").over(order)))
    cells = cells.withColumn("run", F.sum(F.col("new").cast("int")).over(order)).where(F.col("seen").isNotNull())
    return cells.groupBy(*here, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("seen").alias("seen")).drop("run")


def _as_intervals(numbers: DataFrame, block: int) -> DataFrame:
    """``stream, first, last`` of the runs of neighbouring numbers, not across blocks; rows must be unique."""
    n = numbers.select("stream", "number", block_of("number", block).alias("block"))
    n = n.withColumn("run", F.col("number") - F.row_number().over(Window.partitionBy("stream", "block").orderBy("number")))
    return n.groupBy("stream", "block", "run").agg(F.min("number").alias("first"), F.max("number").alias("last")).drop("block", "run")


def disjoint_intervals(claims: DataFrame, bounds: DataFrame, block: int = BLOCK) -> DataFrame:
    """``stream, first, last, seen``: what the claims cover, as intervals that do not overlap.

    ``seen`` is the largest of the claims over the interval.  Intervals that touch across a
    block edge with one ``seen`` are joined.
    """
    scratch = Scratch(claims.sparkSession, "intervals")
    parts = scratch.write(_segments(cut_claims(claims, bounds, block)), "parts")
    # A part goes on with the one before if that ends right there with the same seen: keys of this join are unique.
    ends = parts.select(F.col("stream").alias("e_stream"), (F.col("last") + 1).alias("e_next"), F.col("seen").alias("e_seen"))
    same = (F.col("stream") == F.col("e_stream")) & (F.col("first") == F.col("e_next")) & (F.col("seen") == F.col("e_seen"))
    begins = parts.join(ends, same, "left").select("stream", "block", "first", "last", "seen", F.when(F.col("e_stream").isNull(), F.col("first")).alias("begin"))
    # The latest beginning names the run; a stream of many blocks is worked on in slots of blocks.
    runs = running_by_slots(scratch.write(begins.withColumn("slot", block_of("block", BLOCK)), "begins"), "stream", "slot", ["first"], {"run": ("max", "begin")})
    return runs.groupBy("stream", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("seen").alias("seen")).drop("run")


def pending(events: DataFrame, claims: DataFrame, block: int = BLOCK) -> DataFrame:
    """``stream, number`` of the events still to be processed, each once.

    ``events`` has ``stream, number, arrived`` (several rows of an event: the smallest
    ``arrived`` counts); ``claims`` has ``stream, first, last, seen`` of runs that succeeded.
    An event is done if a claim covers its number and saw at least as far as it arrived, so
    a late arrival inside a claimed range is still found.  Events with a null stream or
    number are no events; a null ``arrived`` was seen by nobody.  Without claims everything
    is pending.

    The claims become disjoint intervals with what they saw (the largest where several
    overlap), which are subtracted from the numbers that exist: at each number the last
    interval that begins at or before it decides.  Streams are cut into blocks of ``block``
    numbers, so a stream with a third of all events is worked on by many tasks.  The two
    sides meet by one exchange of sorted rows; no pairs of claims and events are formed.
    """
    e = events.where(F.col("stream").isNotNull() & F.col("number").isNotNull())
    e = e.groupBy("stream", "number").agg(F.min("arrived").alias("arrived"))
    bounds = e.groupBy("stream").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    none = F.lit(None).cast("long")
    taken = _segments(cut_claims(claims, bounds, block)).select("stream", "block", F.col("first").alias("number"), F.lit(0).alias("kind"), none.alias("arrived"), F.struct("last", "seen").alias("interval"))
    there = e.select("stream", block_of("number", block).alias("block"), "number", F.lit(1).alias("kind"), "arrived", F.lit(None).cast(taken.schema["interval"].dataType).alias("interval"))
    before = Window.partitionBy("stream", "block").orderBy("number", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = taken.unionByName(there).withColumn("interval", F.last("interval", ignorenulls=True).over(before))
    done = (F.col("interval.last") >= F.col("number")) & (F.col("interval.seen") >= F.col("arrived"))
    return met.where((F.col("kind") == 1) & ~F.coalesce(done, F.lit(False))).select("stream", "number")


class IntervalLedger:
    """Runs that take what is new exactly once, whatever becomes of them.

    The state is a table of disjoint intervals per stream and a numbered list of commits.  A
    run writes its output and the merged intervals into a folder of its own; one commit
    file, created exclusively, makes both valid at once.  A run that dies before leaves
    nothing behind that counts; of two runs at once only one can commit.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.path, self.block = spark, full_uri(spark, path).rstrip("/"), block

    def _commits(self) -> list[dict]:
        return [json.loads(read_text(self.spark, f"{self.path}/commits/{n}")) for n in list_names(self.spark, f"{self.path}/commits")]

    def intervals(self) -> DataFrame:
        done = self._commits()
        if not done:
            return self.spark.createDataFrame([], _SEGMENT)
        return self.spark.read.schema(_SEGMENT).parquet(f"{self.path}/{done[-1]['run']}/intervals")

    def output(self) -> DataFrame | None:
        """The output of all committed runs together."""
        done = self._commits()
        return self.spark.read.parquet(*[f"{self.path}/{c['run']}/output" for c in done]) if done else None

    def run(self, events: DataFrame, process: Callable[[DataFrame], DataFrame], seen: int) -> int:
        """Process what is pending of ``events`` (columns stream, number, arrived and more).

        ``process`` gets the pending rows, one or more per event as delivered, and returns the
        output.  ``seen`` is the largest ``arrived`` this run may use; later rows wait.  A null
        ``arrived`` was there from the start: its event goes with the next run, once.
        Returns the number of the commit.
        """
        done = self._commits()
        claims = self.intervals()
        run = f"run-{uuid.uuid4().hex}"
        visible = events.where(F.col("arrived").isNull() | (F.col("arrived") <= seen))
        todo = pending(visible.withColumn("arrived", F.coalesce("arrived", F.lit(-(2**63)))), claims, self.block)
        todo.write.parquet(f"{self.path}/{run}/taken")
        taken = self.spark.read.schema(_PENDING).parquet(f"{self.path}/{run}/taken")
        key = taken.select(F.col("stream").alias("__s"), F.col("number").alias("__n"))
        rows = visible.join(key, (F.col("stream") == F.col("__s")) & (F.col("number") == F.col("__n")), "left_semi")
        process(rows).write.parquet(f"{self.path}/{run}/output")
        fresh = _as_intervals(taken, self.block).withColumn("seen", F.lit(seen).cast("long"))
        every = claims.unionByName(fresh)
        bounds = every.groupBy("stream").agg(F.min("first").alias("low"), F.max("last").alias("high"))
        # With one value of seen the intervals join up; it must not fall behind an earlier run's, or what that run took would be pending again.
        most = max([seen, *(c["seen"] for c in done)])
        disjoint_intervals(every.withColumn("seen", F.lit(most).cast("long")), bounds, self.block).write.parquet(f"{self.path}/{run}/intervals")
        if not create_exclusive(self.spark, f"{self.path}/commits/{len(done):09d}.json", json.dumps({"run": run, "seen": seen})):
            raise RuntimeError("another run committed first; nothing of this run counts")
        return len(done)
