"""Pairs of vectors with a high cosine, without comparing all with all.

The signs of a vector's products with random planes through the origin agree for two vectors with a chance that depends on
their angle alone. BITS signs make a key, and every vector has so many keys, in bands, that two vectors at the threshold share
one with the wanted probability. Of two vectors that share a key all signs are counted, which the keys' rows carry along, and only
pairs that agree as often as similar vectors do leave the join; these are compared exactly. Equal vectors are one from the start, so a
vector that many rows have costs as much as any other.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .taxonomy import cosine

#: Signs of a key. With more rows take more, about log2 of the rows less six, so that few unlike vectors share a key.
BITS, RECALL, SEED = 10, 0.98, 11
#: Standard deviations below the expected count of equal signs down to which a pair is compared: of 3 million pairs at the threshold one is lost.
DEVIATIONS = 5.0


def bands_for(threshold: float, bits: int = BITS, recall: float = RECALL) -> int:
    """How many keys two vectors with a cosine of ``threshold`` need to share one with a probability of ``recall``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


def plane_keys(size: int, bits: int, bands: int, seed: int = SEED):
    """A column function: the ``bands`` keys of a vector with ``size`` numbers. Vectors of another size have none.

    The planes follow from the seed, so every task has the same.
    """
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(vectors: pd.Series) -> pd.Series:
        planes = np.random.default_rng(seed).standard_normal((size, bands * bits))
        powers = 1 << np.arange(bits, dtype=np.int64)
        out: list = [[] for _ in range(len(vectors))]
        fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
        if fits:
            signs = np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in fits]) @ planes > 0
            for i, row in zip(fits, (signs.reshape(len(fits), bands, bits) * powers).sum(axis=2)):
                out[i] = row.tolist()
        return pd.Series(out)

    return keys


def packed_signs(keys: str, bits: int, bands: int) -> list[Column]:
    """The signs of all ``bands`` keys in the array column ``keys``, as many keys to a number as it holds."""
    per = max(1, 63 // bits)
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.get(keys, F.lit(j)), bits * (j - first)) for j in range(first, min(first + per, bands))])
            for first in range(0, bands, per)]


def least_agreement(threshold: float, signs: int) -> int:
    """The fewest equal signs, of ``signs``, that two vectors with a cosine of ``threshold`` have but for rare exceptions (DEVIATIONS)."""
    p = 1 - math.acos(threshold) / math.pi
    return math.floor(signs * p - DEVIATIONS * math.sqrt(signs * p * (1 - p)))


def classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(member, class, vector): each row's key, and of all rows with its vector the least one. NULL, empty and zero vectors have no class."""
    plain = rows.select(F.col(key).alias("member"), F.transform(vector, lambda v: v.cast("double")).alias("vector")) \
        .where(F.exists("vector", lambda v: (v != 0) & ~F.isnan(v)) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v)))
    least = plain.groupBy("vector").agg(F.min("member").alias("class"))
    return plain.join(least, "vector").select("member", "class", "vector")


def similar_classes(left: DataFrame, right: DataFrame, size: int, *, threshold: float, bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """(left, right, similarity): classes of two sides (from :func:`classes`) whose cosine is ``threshold`` or more.

    Every pair found is exact; of the pairs at the threshold ``recall`` are found by expectation, of more similar ones more.
    """
    bands = bands_for(threshold, bits, recall)
    keys, numbers = plane_keys(size, bits, bands), -(-bands // max(1, 63 // bits))
    sides = []
    for side, name in ((left, "left"), (right, "right")):
        one = side.select(F.col("class").alias(name), F.col("vector").alias(f"{name}_vector")).dropDuplicates([name])
        signed = one.select(name, keys(F.col(f"{name}_vector")).alias("_keys"))
        packed = [c.alias(f"{name}_{i}") for i, c in enumerate(packed_signs("_keys", bits, bands))]
        sides.append((one, signed.select(name, *packed, F.posexplode("_keys").alias("band", "key"))))
    (a, a_keys), (b, b_keys) = sides
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"left_{i}").bitwiseXOR(F.col(f"right_{i}"))) for i in range(numbers)])
    met = a_keys.join(b_keys, ["band", "key"]).where(bits * bands - differ >= least_agreement(threshold, bits * bands)).select("left", "right").distinct()
    exact = met.join(a, "left").join(b, "right").select("left", "right", cosine(F.col("left_vector"), F.col("right_vector")).alias("similarity"))
    return exact.where(F.col("similarity") >= threshold)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gram_vector(names: pd.Series) -> pd.Series:
    """A name as the sum of its character 3-grams, each a vector of 256 random signs that follows from the gram: names with most
    grams in common have a high cosine. It stands in where the caller has no embedding model."""
    signs: dict[str, np.ndarray] = {}

    def vector(name: str | None) -> list[float]:
        words = [f" {w} " for w in (name or "").lower().split()]
        total = np.zeros(256)
        for gram in (w[i:i + 3] for w in words for i in range(max(1, len(w) - 2))):
            if gram not in signs:
                signs[gram] = np.random.default_rng(list(gram.encode("utf-8", "surrogatepass"))).integers(0, 2, 256) * 2.0 - 1.0
            total += signs[gram]
        return total.tolist()

    return pd.Series([vector(n) for n in names])


def similar_offers(requests: DataFrame, profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """What :func:`gap.gap_rows` takes as ``similar``: held skills whose name is like that of a skill; ``pairs`` has (skill_id, have_id, similarity)."""
    held = profile.select("candidate_id", F.col("skill_id").alias("have_id"), "level")
    return requests.select("candidate_id", "target_role").join(held.join(pairs, "have_id"), "candidate_id") \
        .select("candidate_id", "target_role", "skill_id", "have_id", "level", "similarity")
