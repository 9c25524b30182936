"""Ordered patterns, gaps allowed, that occur in many sequences: prefix-projected growth."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.runtime import Scratch, block_of, fields

#: Order numbers per block when a long sequence is cut for the first reduction.
BLOCK = 32_768
#: Blocks that are joined to one in each further reduction.
FAN = 16

_POINT = fields("seq string, block long, ord long, id string, code int")
_SEQUENCE = fields("codes array<int>")
_PATTERN = T.StructType([T.StructField("items", T.ArrayType(T.StringType())), T.StructField("support", T.LongType())])


def _useful(n_codes: int, longest: int):
    """A filter for one sequence: is the next item the end of a leftmost match of at most ``longest`` items?

    ``low[c]`` is the least length of a leftmost match that ends at or after the last kept c.
    The leftmost match of a pattern that ends in c at this place takes its item before from
    there on, so this item is the end of such a match of length low[c] + 1, and of none
    shorter.  Growth only ever stands on ends of leftmost matches; all other items can go.
    """
    low = [0] * n_codes

    def keep(code: int) -> bool:
        depth = low[code] + 1
        if depth > longest:
            return False
        for c in range(n_codes):
            if low[c] > depth:
                low[c] = depth
        low[code] = depth
        return True

    return keep


def _reduce_points(n_codes: int, longest: int):
    """Drop from each block what no leftmost match inside the block ends at; rows sorted by (seq, block, ord, id)."""

    def work(batches):
        import pyarrow as pa

        group, keep = None, None
        for b in batches:
            picked = []
            for i, (s, k, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("seq", "block", "code")))):
                if group != (s, k):
                    group, keep = (s, k), _useful(n_codes, longest)
                if keep(c):
                    picked.append(i)
            yield b.take(pa.array(picked, pa.int64()))

    return work


def _sequences(n_codes: int, longest: int):
    """The reduced sequence of each ``seq`` as one array; rows sorted by (seq, ord, id)."""

    def work(batches):
        import pyarrow as pa

        seq, keep, codes = None, None, []
        for b in batches:
            out = []
            for s, c in zip(b.column("seq").to_pylist(), b.column("code").to_pylist()):
                if s != seq or keep is None:
                    if codes:
                        out.append(codes)
                    seq, keep, codes = s, _useful(n_codes, longest), []
                if keep(c):
                    codes.append(c)
            if out:
                yield pa.record_batch([pa.array(out, pa.list_(pa.int32()))], names=["codes"])
        if codes:
            yield pa.record_batch([pa.array([codes], pa.list_(pa.int32()))], names=["codes"])

    return work


def frequent_patterns(
    df: DataFrame, seq_col: str, order_col: str, item_col: str, id_col: str, min_share: float | Fraction = Fraction(1, 10), shortest: int = 3, longest: int = 5, block: int = BLOCK
) -> DataFrame:
    """``items array<string>, support long``: patterns of ``shortest`` to ``longest`` items in at least ``min_share`` of all sequences.

    A sequence is the rows of one ``seq_col`` with a non-null item, by the integer
    ``order_col`` (then by id), repeats of an id counting once; a pattern occurs in it if its
    items come in this order, with any gaps.  The share is taken of all distinct non-null
    ``seq_col``, with items or not.  Rows with a null sequence, order or id do not count.
    An empty table has no patterns.

    Frequent single items are found first; others cannot be in a frequent pattern.  A long
    sequence is cut into blocks of ``block`` order numbers; of each block only the ends of
    leftmost matches stay, a few hundred items whatever its length, and blocks are joined
    and reduced again until a sequence is one block.

    Frequent prefixes then grow by one item a pass over their projections: one row for each
    prefix and sequence that holds it, with the suffix behind the pointer, which stands at
    the end of the leftmost match.  The distinct items of the suffix are the prefix's
    extensions there, each counted once for the sequence; rows whose extension is frequent
    move their pointer behind it and go on.  Prefixes are spread over all tasks, a prefix of
    very many sequences too; prefixes and patterns stay in tables and never come to the driver.
    """
    spark = df.sparkSession
    share = Fraction(min_share).limit_denominator(10**6)
    rows = df.where(F.col(seq_col).isNotNull()).select(F.col(seq_col).cast("string").alias("seq"), F.col(order_col).cast("long").alias("ord"), F.col(item_col).cast("string").alias("item"), F.col(id_col).cast("string").alias("id"))
    valid = F.col("item").isNotNull() & F.col("ord").isNotNull() & F.col("id").isNotNull()
    # One pass counts the sequences (marked by a null item) and those of each item.
    marks = rows.select("seq", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("item")), F.struct(F.lit(False).alias("whole"), F.when(valid, F.col("item")).alias("item")))).alias("m"))
    per_item = marks.select("seq", "m.whole", "m.item").where("whole or item is not null").distinct().groupBy("whole", "item").agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(spark, "patterns")
    per_item = scratch.write(per_item, "items")
    empty = spark.createDataFrame([], _PATTERN)
    n_sequences = per_item.where("whole").agg(F.sum("n")).first()[0] or 0
    if not n_sequences:
        return empty
    need = -(-n_sequences * share.numerator // share.denominator)  # the least whole number that reaches the share
    need = max(need, 1)
    # At most (distinct items per sequence) / share items can be frequent.
    single = {r.item: r.n for r in per_item.where(~F.col("whole") & (F.col("n") >= need)).collect()}
    items = sorted(single)
    if not items:
        return empty
    code = F.create_map(*[x for i, t in enumerate(items) for x in (F.lit(t), F.lit(i))])

    points = rows.where(valid & F.col("item").isin(items)).select("seq", "ord", "id", code[F.col("item")].alias("code")).distinct()
    points = points.select("seq", block_of("ord", block).alias("block"), "ord", "id", "code")
    reduce = _reduce_points(len(items), longest)
    points = points.repartition("seq", "block").sortWithinPartitions("seq", "block", "ord", "id").mapInArrow(reduce, _POINT)
    points = scratch.write(points, "points0")
    span = points.agg(F.min("block").alias("a"), F.max("block").alias("z")).first()
    low, width, k = span.a, span.z - span.a + 1, 0
    while width > FAN:  # only sequences of more than FAN blocks need another reduction before they are joined
        k += 1
        joined = points.withColumn("block", F.col("block") - F.lit(low)).withColumn("block", block_of("block", FAN))
        points = scratch.write(joined.repartition("seq", "block").sortWithinPartitions("seq", "block", "ord", "id").mapInArrow(reduce, _POINT), f"points{k}")
        low, width = 0, -(-width // FAN)
    ordered = points.select("seq", "ord", "id", "code").repartition("seq").sortWithinPartitions("seq", "ord", "id")
    sequences = scratch.write(ordered.mapInArrow(_sequences(len(items), longest), _SEQUENCE), "sequences")

    names = F.array(*[F.lit(t) for t in items])
    # One row per prefix: its number, its item codes, its support.
    prefixes = spark.createDataFrame([(i, [i], single[t]) for i, t in enumerate(items)], "id long, codes array<int>, n long")
    behind = lambda item: F.slice("suffix", F.array_position("suffix", item) + 1, F.size("suffix"))
    projected = sequences.select(F.explode(F.array_distinct("codes")).alias("item"), F.col("codes").alias("suffix"))
    projected = projected.select(F.col("item").cast("long").alias("prefix"), behind(F.col("item")).alias("suffix"))
    levels = [prefixes]
    for k in range(2, longest + 1):
        steps = projected.select("prefix", F.explode(F.array_distinct("suffix")).alias("item"), *(["suffix"] if k < longest else []))
        counts = steps.groupBy("prefix", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
        before = levels[-1].select(F.col("id").alias("b_id"), "codes")
        grown = counts.join(before, F.col("prefix") == F.col("b_id")).select(F.monotonically_increasing_id().alias("id"), F.concat("codes", F.array("item")).alias("codes"), "n", "prefix", "item")
        grown = scratch.write(grown, f"prefixes{k}")
        if grown.isEmpty():
            break
        levels.append(grown)
        if k < longest:
            to = grown.select(F.col("id").alias("t_id"), F.col("prefix").alias("t_prefix"), F.col("item").alias("t_item"))
            moved = steps.join(to, (F.col("prefix") == F.col("t_prefix")) & (F.col("item") == F.col("t_item")))
            projected = scratch.write(moved.select(F.col("t_id").alias("prefix"), behind(F.col("item")).alias("suffix")).where(F.size("suffix") > 0), f"projected{k}", "rebalance")
    out = empty
    for k, level in enumerate(levels, 1):
        if k >= shortest:
            out = out.union(level.select(F.transform("codes", lambda c: F.element_at(names, c + 1)).alias("items"), F.col("n").alias("support")))
    return out
