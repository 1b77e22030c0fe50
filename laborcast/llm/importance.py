"""Target-distribution importance resampling by hashed word runs.

Runs of one or more words are hashed into buckets; counts per bucket of all documents and of all target texts give each
bucket a gain, the log of how much more common it is in the target. A document's weight is the mean gain of its runs; the
weight with Gumbel noise drawn from a hash of its key is its score, and the documents with the highest scores are drawn:
a sample without replacement in which a document's chance grows with its weight.

Words are found, lower-cased, joined and hashed as bytes in numpy (:mod:`position_crc`), so no string is made per word.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .position_crc import crc32_spans
from .shared import cut, extended, with_columns, without
from .wordbytes import parts, word_spans

BUCKETS = 10_000
#: Scores are put into steps of this many thousandths to find from where rows can be drawn; there are some 1,500 steps at most.
STEP = 64


@dataclass(frozen=True)
class Gains:
    """The gain of each bucket, in thousandths, for runs of 1 to ``longest`` words."""

    values: np.ndarray
    longest: int


def runs(column: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of every run, runs of each text, words of each text); the runs of a text stand together, in order of its row.

    Runs are of 1 to ``longest`` consecutive words of a text, joined by one space.
    """
    data, start, size, words = word_spans(column)
    if longest == 1:
        return crc32_spans(data, start, size), words, words
    # words with one space after each, so that a run is one span
    place = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    at = np.arange(int(size.sum()))
    heads = np.cumsum(size) - size
    joined[np.repeat(place - heads, size) + at] = data[np.repeat(start - heads, size) + at]
    owner = np.repeat(np.arange(len(words)), words)
    crcs, owners = [], []
    for n in range(1, longest + 1):
        first = np.arange(max(0, len(start) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]
        last = first + n - 1
        crcs.append(crc32_spans(joined, place[first], place[last] + size[last] - place[first]))
        owners.append(owner[first])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(crcs)[order], np.bincount(np.concatenate(owners), minlength=len(words)), words


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket. Each task sends one row a bucket; ``buckets`` numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for rows in parts(column):
                total += np.bincount(runs(column[rows], longest)[0] % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def learn_gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> Gains:
    """The gain of each bucket: floor(1000 ln of its smoothed share in ``target`` over that in ``docs``). Both are read whole.

    Empty tables are counts of zero; if both are empty, so are all gains.
    """
    s, t = bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets)
    above, below = (t + 1) * float(s.sum() + buckets), (s + 1) * float(t.sum() + buckets)
    return Gains(np.floor(1000 * np.log(above / below)).astype(np.int64), longest)


def weigh(docs: DataFrame, gains: Gains, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_features`` and ``weight`` (long), the floored mean gain of a document's runs; no run gives 0.

    Whole texts are read, null as empty. Every row is judged by its own text, so equal rows have equal results; an empty table
    stays empty. All columns of ``docs`` stay, but those with one of the three names are replaced. Lazy, without a shuffle;
    memory is bounded by the longest text. Each task has the gains, whose number is that of the buckets.
    """
    new = ["n_words", "n_features", "weight"]
    docs = without(docs, *[n for n in new if n.lower() != text.lower()])
    place = docs.columns.index(text)
    buckets = len(gains.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = [], [], []
            column = batch.column(place)
            for rows in parts(column):
                crcs, n, k = runs(column[rows], gains.longest)
                upto = np.concatenate([[0], np.cumsum(gains.values[crcs % buckets])])
                ends = np.cumsum(n)
                words.append(k)
                features.append(n)
                weight.append((upto[ends] - upto[ends - n]) // np.maximum(1, n))
            columns = [np.concatenate([np.empty(0, dtype=np.int64), *c]).astype(np.int64) for c in (words, features, weight)]
            yield with_columns(batch, **{name: pa.array(c) for name, c in zip(new, columns)})

    return docs.mapInArrow(add, extended(docs, *[T.StructField(n, T.LongType()) for n in new]))


def gumbel(key: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for the u in (0, 1) that a hash of ``seed`` and the key gives; a null key counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, key: str = "doc_id", percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Adds ``score`` and ``rank`` to the columns of ``weighed`` (:func:`weigh`); columns of these names are replaced.

    Of the N rows with ``least_words`` words, floor(percent N / 100) get a rank: 1, 2, 3 ... by falling score, then by rising
    key, null first; rows equal in both have any order, each a rank of its own. All other rows have a null rank. An empty
    table stays empty.

    The rows are written to the checkpoint folder once with their scores, so pass what is needed later, without texts.
    Counts per step of the score find from where rows can be drawn; only those are sorted, over ranges of (score, key, row)
    that split a score or key of any size, and numbered within their range after the counts of the ranges before.
    """
    weighed = without(weighed, "score", "rank")
    wide = weighed.select(F.struct(*[F.col(f"`{c}`") for c in weighed.columns]).alias("row"), F.col(f"`{key}`").alias("key"),
                          (F.col("weight") + gumbel(key, seed)).alias("score"), (F.col("n_words") >= least_words).alias("long"))
    scored = cut(wide.withColumn("at", F.monotonically_increasing_id()))
    step = F.floor(F.col("score") / STEP).alias("step")
    steps = sorted(((r["step"], r["n"]) for r in scored.where("long").groupBy(step).agg(F.count("*").alias("n")).collect()), reverse=True)
    quota = percent * sum(n for _, n in steps) // 100
    lowest, above = None, 0
    for lowest, n in steps:
        above += n
        if above >= quota:
            break
    can = F.col("long") & (F.col("score") >= F.lit((lowest or 0) * STEP)) if quota else F.lit(False)
    order = [F.col("score").desc(), F.col("key").asc(), F.col("at").asc()]
    ranged = cut(scored.where(can).repartitionByRange(*order).sortWithinPartitions(*order).select("row", "score", F.spark_partition_id().alias("part")))
    before, total = {}, 0
    for r in sorted(ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before[r["part"]], total = total, total + r["n"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}  # a task has the rows of one part, in order
        for batch in batches:
            ranks = np.empty(batch.num_rows, dtype=np.int64)
            for i, part in enumerate(batch.column(2).to_pylist()):
                seen[part] = seen.get(part, 0) + 1
                ranks[i] = before[part] + seen[part]
            yield with_columns(batch.select([0, 1]), rank=pa.array(ranks, mask=ranks > quota))

    kept = ranged.select("row", "score")
    ranked = ranged.mapInArrow(number, extended(kept, T.StructField("rank", T.LongType())))
    rest = scored.where(~can).select("row", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionAll(rest).select(*[F.col(f"row.`{c}`") for c in weighed.columns], "score", "rank")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 10, least_words: int = 20, seed: int = 2024,
             longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The drawn documents: the columns of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``."""
    found = draw(weigh(docs, learn_gains(docs, target, text, longest, buckets), text), key, percent, least_words, seed)
    return found.where(F.col("rank").isNotNull())
