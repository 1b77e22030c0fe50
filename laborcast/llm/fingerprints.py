"""Order MinHash fingerprints of whole texts, and pairs of neighbouring documents to compare them on.

All k-mers of a text's characters are numbered by occurrence, so that a repeated k-mer counts as several. Each goes to one
of SLOTS slots by its hash; a slot selects its smallest LENGTH k-mers, puts them back in text order and hashes the tuple.
Two texts agree in a slot only if it selects the same k-mers in the same order, which falls with edit distance.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import extended, slices, with_columns, without

K, SLOTS, LENGTH = 8, 64, 2
_SLOT_BITS = SLOTS.bit_length() - 1
_POSITIONS = 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _numbered(text: str) -> np.ndarray:
    """Hashes of the text's k-mers, each with its occurrence number, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = min(K, len(codes))
    n = len(codes) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + n]
    h = _mix(h)
    if n < 1 << _POSITIONS:
        low = np.uint64((1 << _POSITIONS) - 1)
        ordered = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        at, runs = (ordered & low).astype(np.int64), ordered >> np.uint64(_POSITIONS)
    else:
        at = np.argsort(h, kind="stable")
        runs = h[at] >> np.uint64(_POSITIONS)
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    if len(first) == n:
        return h
    number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    numbered = h.copy()
    numbered[at] = _mix(h[at] + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(_back(number, at) == 0, h, numbered)


def _back(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[at] = values
    return out


def signature(text: str) -> np.ndarray:
    """The slots' 32-bit tuple hashes; zero where a slot has no k-mer, as all have for an empty text."""
    out = np.zeros(SLOTS, dtype=np.uint32)
    if not text:
        return out
    h = _numbered(text)
    shift = np.uint64(64 - _SLOT_BITS)
    values = h & ((np.uint64(1) << shift) - np.uint64(1))
    few = np.arange(len(h))
    if len(h) > 32 * SLOTS:  # the smallest values are enough, unless a slot then has too few
        few = np.flatnonzero(values < np.uint64((1 << int(shift)) * 24 * SLOTS // len(h)))
        if (np.bincount((h[few] >> shift).astype(np.int64), minlength=SLOTS) < LENGTH).any():
            few = np.arange(len(h))
    chosen = few[np.argsort(h[few], kind="stable")]
    slot = (h[chosen] >> shift).astype(np.int64)
    start = np.searchsorted(slot, np.arange(SLOTS + 1))
    none = len(h)
    picked = np.full((SLOTS, LENGTH), none, dtype=np.int64)
    for j in range(LENGTH):
        have = start[:-1] + j < start[1:]
        picked[have, j] = chosen[start[:-1][have] + j]
    picked.sort(axis=1)  # text order
    padded = np.append(h, np.uint64(0))
    total = np.full(SLOTS, LENGTH, dtype=np.uint64)
    for j in range(LENGTH):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + padded[picked[:, j]])
    full = start[1:] > start[:-1]
    out[full] = np.maximum((total[full] >> np.uint64(32)).astype(np.uint32), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots that agree, of those that either text fills; 1 if neither fills any."""
    either = (a != 0) | (b != 0)
    return float(((a == b) & either).sum() / either.sum()) if either.any() else 1.0


def spelled(a: np.ndarray) -> str:
    """The signature as hexadecimal digits, eight to a slot."""
    return a.astype(">u4").tobytes().hex()


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the spelled signature as ``name``, replacing a column of that name. A null text counts as empty."""
    source = without(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            yield with_columns(part, **{name: pa.array([spelled(signature(t)) for t in texts], pa.string())})

    return source.mapInArrow(run, extended(source, T.StructField(name, T.StringType(), False)))


def with_next(docs: DataFrame, key: str, text: str, name: str = "next_text") -> DataFrame:
    """(``key``, ``text``, ``name``) with the text of the next row by descending key; the last row's next is the first.

    Rows are dealt by ranges of the key, whose bounds are quantiles, and each range also gets a copy of the first row of
    the range after it; so the order is whole although no task sees more than a range. Null keys come last, equal keys
    are ordered by text. Null texts are empty.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    parts = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.where(k.isna(), len(bounds) + 1, len(bounds) - np.searchsorted(bounds, k.fillna(0), side="right")).astype(np.int32))

    rows = rows.withColumn("part", range_of(F.col("k").cast("double")))
    heads = rows.groupBy("part").agg(F.max("k").alias("k"))
    order = sorted(r.part for r in heads.select("part").collect())  # ranges, not rows
    if not order:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema[key], T.StructField(text, T.StringType()), T.StructField(name, T.StringType())]))
    before = docs.sparkSession.createDataFrame(list(zip(order, order[-1:] + order[:-1])), "part int, before int")
    heads = heads.join(F.broadcast(before), "part")
    firsts = (rows.alias("r").join(F.broadcast(heads).alias("h"), (F.col("r.part") == F.col("h.part")) & F.col("r.k").eqNullSafe(F.col("h.k")))
              .groupBy("h.before").agg(F.min("r.t").alias("t")).select(F.lit(None).cast(docs.schema[key].dataType).alias("k"), "t", F.col("before").alias("part"), F.lit(True).alias("extra")))
    ordered = Window.partitionBy("part").orderBy("extra", F.desc_nulls_last("k"), "t")
    paired = rows.withColumn("extra", F.lit(False)).unionByName(firsts).withColumn("n", F.lead("t").over(ordered))
    return paired.where("NOT extra").select(F.col("k").alias(key), F.col("t").alias(text), F.col("n").alias(name))


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    ``edited`` is the text with its last half (rounded down) replaced by as many first characters of the next row's text
    as it has. See :func:`with_next` for the order, nulls and ties; a single row is its own next one. Repeated rows each
    give a row, other columns are dropped, no rows give no rows.
    """
    pairs = with_next(docs, key, text)
    fields = T.StructType([
        docs.schema[key], T.StructField("n_chars", T.LongType()), T.StructField("edited", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", signature(""))
        for part, texts in slices(batches, text):
            out = []
            for t, following in zip(texts, part.column(2).to_pylist()):
                own = last[1] if last[0] == t else signature(t)
                last = (following, own if following == t else signature(following))
                half = len(t) // 2
                edited = t[:len(t) - half] + following[:half]
                changed = own if edited == t else signature(edited)
                out.append((len(t), edited, spelled(own), spelled(changed), likeness(own, changed), likeness(own, last[1])))
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*out), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=fields.names)

    return pairs.mapInArrow(run, fields)
