"""Which texts contain which patterns, without comparing every pair.

A text can only contain a pattern if it contains every 3-gram of it. Each pattern is anchored on the 3-gram it
shares with the fewest other patterns, distinct texts are exploded to their grams once, the two are joined on
the gram, and the few candidates are verified.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))
    return F.filter(found, lambda g: F.length(g) == size)


def contains_join(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """Distinct pairs (pattern, text) where the text contains the pattern. Both columns keep their names."""
    p, t = F.col("_pattern"), F.col("_text")
    own = F.when(F.length(p) < GRAM, F.array(p)).otherwise(grams(p, GRAM))
    anchors = patterns.where(F.coalesce(F.col(pattern), F.lit("")) != "").select(F.col(pattern).alias("_pattern")).distinct() \
        .select("_pattern", F.explode_outer(own).alias("_gram")) \
        .select("_pattern", "_gram", F.count(F.lit(1)).over(W.partitionBy("_gram")).alias("_shared")) \
        .groupBy("_pattern").agg(F.min_by("_gram", F.struct("_shared", "_gram")).alias("_gram"))
    # Grams of one and two characters serve patterns shorter than GRAM.
    every = F.concat(*[grams(t, n) for n in range(1, GRAM + 1)])
    text_grams = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct() \
        .select("_text", F.explode_outer(every).alias("_gram"))
    return text_grams.join(anchors, "_gram").where(t.contains(p)).select(p.alias(pattern), t.alias(text))


def any_token_join(queries: DataFrame, key: str, tokens: str, texts: DataFrame, text: str) -> DataFrame:
    """(key, text, hits): how many of a query's tokens each distinct text contains.

    ``hits = size(tokens)`` is the AND of the tokens, ``hits >= 1`` the OR.
    """
    exploded = queries.select(key, F.explode(F.array_distinct(tokens)).alias("_token"))
    pairs = contains_join(exploded, "_token", texts, text)
    return exploded.join(pairs, "_token").groupBy(key, text).agg(F.count(F.lit(1)).alias("hits"))


def two_way_join(left: DataFrame, left_text: str, right: DataFrame, right_text: str) -> DataFrame:
    """Distinct pairs where either text contains the other."""
    forward = contains_join(left, left_text, right, right_text).select(left_text, right_text)
    backward = contains_join(right, right_text, left, left_text).select(left_text, right_text)
    return forward.union(backward).distinct()


def staged_join(roles: DataFrame, texts: DataFrame, text: str, *, two_way: bool) -> DataFrame:
    """(role, text, stage) for roles with a ``phrase`` and a ``last_word``.

    Stage 1: the text contains the phrase (or, ``two_way``, is contained in it); stage 2: it contains the last word.
    """
    terms = roles.select("role", F.explode(F.array(
        F.struct(F.col("phrase").alias("term"), F.lit(1).alias("stage")),
        F.struct(F.col("last_word").alias("term"), F.lit(2).alias("stage")))).alias("_t")).select("role", "_t.term", "_t.stage")
    hits = terms.join(contains_join(terms, "term", texts, text), "term").select("role", text, "stage")
    if not two_way:
        return hits
    inside = contains_join(texts, text, roles, "phrase")
    return hits.union(roles.select("role", "phrase").join(inside, "phrase").select("role", text, F.lit(1).alias("stage"))).distinct()
