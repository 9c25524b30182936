"""Repetition inside documents: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.runtime import Scratch

#: Letters in a run that counts as repeated.
RUN = 20
#: Texts longer than this many characters are taken apart into rows instead of arrays; the result is the same.
LONG_TEXT = 400_000

#: Frequent function words (for Japanese, particles and other Hiragana) of the languages of web text (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it with as on be at by this from or an are not you we was have".split(),
    "de": "der die das und zu den von mit ist im in für auf nicht ein eine es sich auch dem".split(),
    "fr": "de la le les et des en un une est que pour dans du par sur il pas au qui".split(),
    "es": "de la el en y los que las un por con una para es del se no al lo su".split(),
    "pl": "i w na z do nie się to że o jest jak po od za ale co dla".split(),
    "ru": "и в на не с что по это как к из за от для он но у о".split(),
    "el": "και το να του η της με για την από που είναι τα στο ο οι των σε θα τον".split(),
    "ar": "في من على إلى أن هذا التي عن مع ما لا كان هذه أو و لم".split(),
    "ja": "の は を に が と で も へ か な た て い れ る し す".split(),
}

#: Scripts that are written without spaces: each character counts as a word (fixed value).
SINGLE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, inside one expression."""
    return F.transform(F.array(value), use)[0]


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def letters_of(text: Column) -> Column:
    """The letters of a text, in lower case."""
    return F.lower(F.regexp_replace(_text(text), r"[^\p{L}]+", ""))


def _windows(letters: Column, run: int) -> Column:
    """Every run of ``run`` letters in order of its place, none if there are fewer letters.

    One pass of a pattern that looks ahead and goes on by one letter.
    """
    return F.regexp_extract_all(letters, F.lit(f"(?=(.{{{run}}}))."), F.lit(1))


def _covered(starts: Column, run: int) -> Column:
    """Letters covered by runs that begin at the given ascending places."""
    steps = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(b - a, F.lit(run)))
    return F.aggregate(steps, F.lit(run), lambda total, x: total + x)


def repeated_letters(text: Column, at_least: float = 0.0, run: int = RUN) -> Column:
    """Share of the letters that lie in a run of ``run`` letters which also begins earlier in the text.

    Runs may overlap.  Null, empty and texts of fewer letters than a run have 0.  Where the
    number of repeated runs shows that the share cannot reach ``at_least``, 0 is returned.
    """

    def exact(windows: Column) -> Column:
        # Equal windows lie side by side when sorted with their places; all but the first of each are repeats.
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            later = F.slice(s, 2, F.size(s))
            marked = F.zip_with(F.slice(s, 1, F.size(s) - 1), later, lambda a, b: F.when(a["w"] == b["w"], b["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        return _let(placed, lambda s: _let(repeats(s), lambda starts: _covered(starts, run)))

    def share(letters: Column) -> Column:
        def of(windows: Column) -> Column:
            repeats = F.size(windows) - F.size(F.array_distinct(windows))
            possible = _let(repeats, lambda m: (m > 0) & (m.cast("double") * run >= F.length(letters) * at_least))
            return F.when(possible, _share(exact(windows), F.length(letters))).otherwise(F.lit(0.0))

        return _let(_windows(letters, run), of)

    return _let(letters_of(text), share)


def _chars(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda t, x: t + F.length(x))


def _repeat_share(parts: Column) -> Column:
    """Share of the characters of the parts that lie in parts which came before."""
    return _let(parts, lambda p: _share(_chars(p) - _chars(F.array_distinct(p)), _chars(p)))


def _lines(text: Column, at: str) -> Column:
    return F.filter(F.transform(F.split(_text(text), at), lambda s: F.trim(s)), lambda s: s != "")


def _line_share(lines: Column, test: Callable[[Column], Column]) -> Column:
    return _share(F.size(F.filter(lines, test)), F.size(lines))


def _words(text: Column) -> Column:
    """Words in lower case; of scripts without spaces every character is one."""
    parted = F.regexp_replace(F.lower(_text(text)), f"({SINGLE})", " $1 ")
    return F.filter(F.split(parted, r"[^\p{L}\p{N}']+"), lambda w: w != "")


def _stop_share(words: Column) -> Column:
    """Share of the words that are stop words of the one language that has most of them."""
    every = sorted({w for own in STOP_WORDS.values() for w in own})

    def count(stops: Column, own: list[str]) -> Column:
        return F.size(F.filter(stops, lambda x: x.isin(own)))

    def most(stops: Column) -> Column:
        return F.greatest(*[count(stops, own) for own in STOP_WORDS.values()])

    return _share(_let(F.filter(words, lambda x: x.isin(every)), most), F.size(words))


def _word_runs(words: Column, n: int) -> Column:
    """Share of the runs of ``n`` words that came before in the text."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) < n, F.lit(0.0)).otherwise(_let(grams, lambda g: _share(F.size(g) - F.size(F.array_distinct(g)), F.size(g))))


@dataclass(frozen=True)
class Parts:
    """A text and what several ratios are taken of, so that each is made once."""

    text: Column
    words: Column
    lines: Column


#: Every ratio that a threshold can name, as an expression of the text's parts and of the threshold to be decided.
METRICS: dict[str, Callable[[Parts, float], Column]] = {
    "n_chars": lambda p, _: F.length(p.text).cast("double"),
    "n_words": lambda p, _: F.size(p.words).cast("double"),
    "mean_word": lambda p, _: _share(_chars(p.words), F.size(p.words)),
    "symbol_share": lambda p, _: _share(F.length(F.regexp_replace(p.text, r"[\p{L}\p{N} \t-\r]+", "")), F.length(p.text)),
    "digit_share": lambda p, _: _share(F.length(F.regexp_replace(p.text, r"[^\p{N}]+", "")), F.length(p.text)),
    "stop_word_share": lambda p, _: _stop_share(p.words),
    "bullet_line_share": lambda p, _: _line_share(p.lines, lambda s: s.rlike(r"^[-*•·]")),
    "ellipsis_line_share": lambda p, _: _line_share(p.lines, lambda s: s.rlike(r"(\.\.\.|…)\z")),
    "repeated_line_share": lambda p, _: _repeat_share(p.lines),
    "repeated_block_share": lambda p, _: _repeat_share(_lines(p.text, r"\n[ \t-\r]*\n")),
    "repeated_sentence_share": lambda p, _: _repeat_share(_lines(p.text, r"[.!?。！？]+[ \t-\r]*|\n+")),
    "repeated_words5_share": lambda p, _: _word_runs(p.words, 5),
    "repeated_letter_share": lambda p, least: repeated_letters(p.text, least),
}


@dataclass(frozen=True)
class Threshold:
    """``flag`` is set where ``metric`` compares as ``op`` (``>=`` or ``<=``) with ``value``."""

    flag: str
    metric: str
    op: str
    value: float


#: The table for web text.  The limits are parameters; these are the defaults.
THRESHOLDS = (
    Threshold("too_short", "n_words", "<=", 20),
    Threshold("many_symbols", "symbol_share", ">=", 0.2),
    Threshold("few_stop_words", "stop_word_share", "<=", 0.02),
    Threshold("bullets", "bullet_line_share", ">=", 0.9),
    Threshold("cut_lines", "ellipsis_line_share", ">=", 0.3),
    Threshold("repeated_lines", "repeated_line_share", ">=", 0.3),
    Threshold("repeated_blocks", "repeated_block_share", ">=", 0.3),
    Threshold("repeated_sentences", "repeated_sentence_share", ">=", 0.3),
    Threshold("repeated_words", "repeated_words5_share", ">=", 0.25),
    Threshold("repeated_letters", "repeated_letter_share", ">=", 0.4),
)

REPEATED_LETTERS = (Threshold("repeated_letters", "repeated_letter_share", ">=", 0.4),)


def compile_thresholds(rows: DataFrame, text_col: str, table, decide_only: bool = False, given: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the ratios of a threshold table over a text column, each made once, and its flags.

    Nothing but built-in expressions in one stage: words and lines, then ratios, then flags.
    With ``decide_only`` only the flags are added, and a ratio may be taken as 0 where it is
    sure to miss its thresholds, which is cheaper.  ``given`` names the columns of ratios that
    ``rows`` has already.
    """
    if bad := [t for t in table if t.op not in (">=", "<=") or t.metric not in METRICS]:
        raise ValueError(f"unknown metric or comparison: {bad}")
    metrics = list(dict.fromkeys(t.metric for t in table))

    def least(m: str) -> float:
        own = [t for t in table if t.metric == m]
        return min(t.value for t in own) if decide_only and all(t.op == ">=" for t in own) else 0.0

    text = _text(F.col(text_col))
    parts = rows.withColumns({"__text": text, "__words": _words(text), "__lines": _lines(text, "\n")})
    of = Parts(F.col("__text"), F.col("__words"), F.col("__lines"))
    ratios = parts.select(*rows.columns, *[(F.col(given[m]) if given and m in given else METRICS[m](of, least(m))).alias(m) for m in metrics])
    flags = [(F.col(t.metric) >= t.value if t.op == ">=" else F.col(t.metric) <= t.value).alias(t.flag) for t in table]
    return ratios.select(*rows.columns, *([] if decide_only else metrics), *flags)


def _long_texts(df: DataFrame, id_col: str, text_col: str, run: int = RUN, width: int = 4096) -> DataFrame:
    """``row, id, share`` of repeated letters for very long texts, spread by windows and by blocks of letters.

    Of each window only the first place matters: all other places repeat it.  First places
    are found by (row, window) with map-side combining, so a text of one letter is no hot
    group, and go to the block of ``width`` letters they may lie in.  A block knows its places and
    those just before, so it counts its covered letters alone.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), letters_of(F.col(text_col)).alias("letters"))
    rows = rows.select("row", "id", "letters", F.length("letters").cast("long").alias("n"))
    numbers = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(n - 1) div {width}"), F.lit(0).cast("long")))
    blocks = rows.select("row", "id", "n", F.explode(numbers).alias("b"), "letters").select("row", "id", "n", "b", F.expr(f"substring(letters, int(b * {width} + 1), {width + run - 1})").alias("s"))
    blocks = Scratch(df.sparkSession, "texts").write(blocks, "blocks")
    windows = blocks.select("row", F.col("b").alias("in_b"), F.posexplode(_windows(F.col("s"), run)).alias("j", "w")).where(F.col("j") < width)
    firsts = windows.groupBy("row", "w").agg(F.min(F.col("in_b") * width + F.col("j")).alias("i"))
    home = F.expr(f"i div {width}")
    also = F.when(F.col("i") % width > width - run, F.array(home, home + 1)).otherwise(F.array(home))
    placed = firsts.select("row", "i", F.explode(also).alias("b")).groupBy(F.col("row").alias("p_row"), F.col("b").alias("p_b")).agg(F.collect_list("i").alias("firsts"))
    met = blocks.select("row", "id", "n", "b").join(placed, (F.col("row") == F.col("p_row")) & (F.col("b") == F.col("p_b")), "left")
    start = F.col("b") * width
    end, last = F.least(start + width, F.col("n")), F.least(start + width, F.col("n") - (run - 1)) - 1
    low = F.greatest(start - (run - 1), F.lit(0))
    places = F.when(last < low, F.array().cast("array<bigint>")).otherwise(F.sequence(low, last))
    repeats = F.array_sort(F.array_except(places, F.coalesce("firsts", F.array().cast("array<bigint>"))))

    def covered(r: Column) -> Column:
        following = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.array(F.lit(2**62).cast("long")))
        held = F.zip_with(r, F.slice(following, 1, F.size(r)), lambda a, b: F.greatest(F.least(a + run, b, end) - F.greatest(a, start), F.lit(0).cast("long")))
        return F.aggregate(held, F.lit(0).cast("long"), lambda t, x: t + x)

    whole = met.select("row", "id", "n", _let(repeats, covered).alias("covered")).groupBy("row", "id", "n").agg(F.sum("covered").alias("covered"))
    return whole.select("row", "id", _share(F.col("covered"), F.col("n")).alias("share"))


def measure(df: DataFrame, id_col: str, text_col: str, table=THRESHOLDS, long_text: int = LONG_TEXT) -> DataFrame:
    """``id_col`` with every ratio and flag of the table, one row per row, all in one projection.

    Texts are read once.  Only of texts of more than ``long_text`` characters, which are
    put aside in the shared folder, the repeated letters are found on windows spread as rows,
    with the same result.

    Null and empty texts have ratios of 0 (and the flags that follow).  Rows with repeated or null
    ids are kept.  Other columns of the input play no part.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__raw"))
    if all(t.metric != "repeated_letter_share" for t in table):
        return compile_thresholds(rows, "__raw", table).drop("__raw").withColumnRenamed("__id", id_col)
    done, long = _set_aside(rows, table, long_text, False)
    done = done.drop("__far")
    if long.isEmpty():
        return done.withColumnRenamed("__id", id_col)
    shares = _long_texts(long, "__row", "__far").select(F.col("id").alias("__of"), F.col("share").alias("__share"))
    known = long.join(shares, F.col("__row") == F.col("__of")).select("__id", "__far", "__share")
    far = compile_thresholds(known, "__far", table, given={"repeated_letter_share": "__share"}).drop("__far", "__share")
    return done.unionByName(far).withColumnRenamed("__id", id_col)


def _set_aside(rows: DataFrame, table, long_text: int, decide_only: bool) -> tuple[DataFrame, DataFrame]:
    """The compiled table over ``__id, __raw`` without long texts, and the long texts (``__id, __far, __row``), in one pass.

    With ``decide_only`` only rows with a flag are kept.
    """
    is_long = F.coalesce(F.length("__raw"), F.lit(0)) > long_text
    apart = rows.select("__id", F.when(~is_long, F.col("__raw")).alias("__raw"), F.when(is_long, F.col("__raw")).alias("__far"))
    out = compile_thresholds(apart, "__raw", table, decide_only).drop("__raw")
    if decide_only:
        flags = [F.col(t.flag) for t in table]
        out = out.where(F.col("__far").isNotNull() | reduce(lambda a, b: a | b, flags))
    out = Scratch(rows.sparkSession, "texts").write(out.withColumn("__row", F.monotonically_increasing_id()), "measured")
    return out.where("__far IS NULL").drop("__row"), out.where("__far IS NOT NULL").select("__id", "__far", "__row")


def repeated_documents(df: DataFrame, id_col: str, text_col: str, at_least: float = 0.4, long_text: int = LONG_TEXT) -> DataFrame:
    """``id_col`` of the documents of whose letters at least the share ``at_least`` is repeated.

    Decided by the compiled threshold table in one projection that reads each text once; only
    texts of more than ``long_text`` characters, whose windows would make too large an array
    for one row, are put aside and decided on windows spread as rows, with the same result.
    """
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__raw"))
    table = (Threshold("repeated_letters", "repeated_letter_share", ">=", at_least),)
    done, long = _set_aside(rows, table, long_text, True)
    short = done.select(F.col("__id").alias("id"))
    if long.isEmpty():
        return short.withColumnRenamed("id", id_col)
    far = _long_texts(long, "__id", "__far").where(F.col("share") >= at_least).select("id")
    return short.union(far).withColumnRenamed("id", id_col)
