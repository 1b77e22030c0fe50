"""Quality rules whose thresholds come from the data.

Every document is measured once. For each language and source, quantile sketches of the measures give the middle and both
tails, and a document is out if a measure lies far beyond those of its own kind. A sketch is a table of counts per value bucket: a
measure is a whole number, and a bucket keeps its first three digits, so a quantile is off by less than one in a hundred.
Counts add up, so sketches of parts merge exactly, in any order, and the result is the same in every run.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, extended, slices, with_columns, without
from .textstats import line_counts, repeated_words

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim"]
#: Measures in thousandths: (name, counted, out of, spare, low side too). A document may be ``spare`` counted ones beyond a
#: fence, as short texts scatter by whole characters, words and lines; in longer texts that is next to nothing.
MEASURES = [
    ("word_length", "word_chars", "n_words", 30, True),
    ("symbol_rate", "n_symbols", "n_words", 3, False),
    ("repeated_line_rate", "n_dup_lines", "n_lines", 2, False),
    ("repeated_word_rate", "n_repeat_words", "n_words", 20, False),
    ("upper_rate", "n_upper", "word_chars", 10, False),
    ("exclaim_rate", "n_exclaim", "n_words", 3, False),
]
#: A fence lies this many spreads from the middle. The spread is the distance of the middle from the farther of the two
#: quantiles TAILS, in percent, and a thousandth at least, the resolution of a sketch.
FENCE, TAILS = 5, (15, 85)
#: A language and source with fewer documents uses its language's sketches; a language with fewer, those of all.
ENOUGH = 100
MIN_WORDS, MAX_REPEATED = 10, 20


def measure(text: str) -> tuple[int, ...]:
    """The counts named by COUNTS for one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, repeats = line_counts(text)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    upper = sum(map(str.isupper, text))
    return len(words), chars, sum(map(text.count, SYMBOLS)), lines, repeats, repeated_words(words), upper, text.count("!")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts as long columns, which replace columns of the same names. A null text counts as empty."""
    source = without(docs, *COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            values = list(zip(*map(measure, texts))) or [[] for _ in COUNTS]
            yield with_columns(part, **{c: pa.array(v, pa.int64()) for c, v in zip(COUNTS, values)})

    return source.mapInArrow(run, extended(source, *[T.StructField(c, T.LongType(), False) for c in COUNTS]))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def rate(counted: str, out_of: str) -> Column:
    """Thousandths, rounded down; zero if there is nothing to count in."""
    return F.when(F.col(out_of) > 0, F.expr(f"(1000 * {counted}) div {out_of}")).otherwise(F.lit(0)).cast("long")


def bucket(value: str) -> Column:
    """The lower end of the value's bucket: its first three digits."""
    return F.expr(f"CASE WHEN {value} < 1000 THEN {value} ELSE {value} - {value} % CAST(rpad('1', length(CAST({value} AS string)) - 2, '0') AS BIGINT) END")


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): counts for each language and source, each language, and all.

    ``level`` is 2, 1 or 0. Rows are counted before the shuffle, so a source with a third of all rows costs no more than
    another; the coarser levels are added up from the finest.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), rate(a, b).alias("value")) for name, a, b, _, _ in MEASURES])
    long = measured.where("n_words > 0").select("lang", "source", F.inline(pairs))
    finest = long.withColumn("bucket", bucket("value")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    spread = F.array(*[F.struct(F.lit(i).alias("level"), (F.col("lang") if i > 0 else F.lit("")).alias("lang"), (F.col("source") if i > 1 else F.lit("")).alias("source")) for i in range(3)])
    return finest.select(F.inline(spread), "measure", "bucket", "n").groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n_docs, fences): a struct of low and high for each measure, from quantiles of the sketches.

    A quantile is the bucket of the value at rank ceil(n q). A sketch has few buckets whatever it has counted, so its
    window is small.
    """
    group = ["level", "lang", "source", "measure"]
    within = Window.partitionBy(*group)
    ranked = sketch.withColumn("upto", F.sum("n").over(within.orderBy("bucket"))).withColumn("total", F.sum("n").over(within))
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket")))
    quantiles = ranked.groupBy(*group).agg(F.max("total").alias("n_docs"), at(TAILS[0]).alias("lo"), at(50).alias("mid"), at(TAILS[1]).alias("hi"))
    spread = F.greatest(F.col("hi") - F.col("mid"), F.col("mid") - F.col("lo"), F.lit(1))
    fence = quantiles.select(*group, "n_docs", (F.col("mid") - FENCE * spread).alias("low"), (F.col("mid") + FENCE * spread).alias("high"))
    one = [F.max(F.when(F.col("measure") == name, F.struct("low", "high"))).alias(name) for name, *_ in MEASURES]
    return fence.groupBy("level", "lang", "source").agg(F.max("n_docs").alias("n_docs"), F.struct(*one).alias("fences"))


def inside(fence: Column) -> Column:
    """Whether every measure lies within its fences, give or take what is spare."""
    tests = []
    for name, counted, out_of, spare, low in MEASURES:
        tests.append(1000 * F.col(counted) <= fence[name]["high"] * F.col(out_of) + 1000 * spare)
        if low:
            tests.append(1000 * F.col(counted) >= fence[name]["low"] * F.col(out_of) - 1000 * spare)
    return reduce(Column.__and__, tests)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the text, with the counts, ``base_failed``, ``fence_level`` and ``kept``; columns of these names are replaced.

    A document is kept unless a base rule fails or a measure lies beyond the fences of its language and source.
    ``fence_level`` says whose fences judged it: 2 its language and source, 1 its language, 0 all; null if nothing was
    measured. A null language or source is a kind of its own, the same as an empty one. A null or empty text has no words
    and fails. Every row is judged, repeated ones too. The texts are read once: their counts are written to the checkpoint
    folder and both the sketches and the filter read those. No rows give no rows.
    """
    carried = [c for c in docs.columns if c.lower() not in {n.lower() for n in (text, *COUNTS, "base_failed", "fence_level", "kept")}]
    kind = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{text}`").alias("text"), *kind)  # the caller's columns stay apart
    measured = cut(with_counts(wrapped).drop("text"))
    bounds = fences(sketches(measured))
    enough = bounds.where(F.col("n_docs") >= ENOUGH)
    level = lambda i, *names: enough.where(F.col("level") == i).select(*names, F.col("fences").alias(f"fences{i}"))
    everyone = bounds.where("level = 0").select("fences").scalar()
    kinds = bounds.where("level = 2").select("lang", "source")
    known = kinds.join(level(2, "lang", "source"), ["lang", "source"], "left").join(level(1, "lang"), "lang", "left").select(
        "lang", "source", F.coalesce("fences2", "fences1", everyone).alias("fence"), F.when(F.col("fences2").isNotNull(), 2).when(F.col("fences1").isNotNull(), 1).otherwise(0).alias("fence_level"))
    joined = measured.join(known, ["lang", "source"], "left")
    kept = ~base_failed() & inside(F.col("fence"))
    return joined.select(*[F.col(f"row.`{c}`") for c in carried], *COUNTS, base_failed().alias("base_failed"), "fence_level", F.coalesce(kept, F.lit(False)).alias("kept"))
