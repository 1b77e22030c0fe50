"""Exact order statistics and top-k that hold when one group has a third of all rows.

Nothing here sorts a whole group in one task. Order statistics first collapse equal values, then count rows per
coarse value bucket, find the one bucket each wanted rank falls into, and sort only those buckets.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STEPS = 512  # buckets per power of two


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a number: each power of two is cut into equal steps.

    The bucket depends on the value alone, so it needs no sampling pass and is the same on every recomputation.
    """
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(size))
    step = F.floor(size / F.pow(F.lit(2.0), exponent) * STEPS)
    code = (exponent + 1100) * (2 * STEPS + 2) + step
    return F.when(value == 0, F.lit(0)).when(value > 0, code).otherwise(-code).cast("long")


def rank_values(df: DataFrame, by: list[str], value: str, targets: dict[str, Callable[[Column], Column]],
                weight: str | None = None) -> DataFrame:
    """One row per group: ``n`` (rows, or total weight) and, per target, the first value whose running count
    reaches ``target(n)``.

    ``by`` columns must not be NULL. Rows with a NULL value are left out.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(w).alias("_w")) \
        .withColumn("_bucket", value_bucket(F.col(value)))
    per_bucket = counts.groupBy(*by, "_bucket").agg(F.sum("_w").alias("_bw"))
    group, running = W.partitionBy(*by), W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    placed = per_bucket.withColumn("n", F.sum("_bw").over(group)).withColumn("_upto", F.sum("_bw").over(running)) \
        .withColumn("_before", F.col("_upto") - F.col("_bw"))
    goals = F.array(*[F.struct(F.lit(name).alias("name"), fn(F.col("n")).cast("double").alias("goal"))
                      for name, fn in targets.items()])
    wanted = placed.select(*by, "_bucket", "n", "_before", "_upto", F.explode(goals).alias("_t")) \
        .where((F.col("_t.goal") > F.col("_before")) & (F.col("_t.goal") <= F.col("_upto"))) \
        .groupBy(*by, "_bucket", "n", "_before").agg(F.collect_list("_t").alias("_targets"))
    inside = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    hits = counts.join(wanted, [*by, "_bucket"]).withColumn("_cum", F.col("_before") + F.sum("_w").over(inside))
    reached = hits.select(*by, "n", value, "_cum", F.explode("_targets").alias("_t")).where(F.col("_cum") >= F.col("_t.goal"))
    return reached.groupBy(*by).agg(F.max("n").alias("n"), *[
        F.min(F.when(F.col("_t.name") == name, F.col(value))).alias(name) for name in targets])


def floor_percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """``sorted(values)[int(n * q)]`` per group."""
    def at(q: float) -> Callable[[Column], Column]:
        return lambda n: F.least(F.floor(n * q) + 1, n)

    return rank_values(df, by, value, {name: at(q) for name, q in points.items()})


def linear_percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles interpolated between the two closest ranks."""
    def low(q: float) -> Callable[[Column], Column]:
        return lambda n: F.floor((n - 1) * q) + 1

    def high(q: float) -> Callable[[Column], Column]:
        return lambda n: F.least(F.floor((n - 1) * q) + 2, n)

    targets: dict[str, Callable[[Column], Column]] = {}
    for name, q in points.items():
        targets[f"{name}_lo"], targets[f"{name}_hi"] = low(q), high(q)
    ranks = rank_values(df, by, value, targets)

    def blend(name: str, q: float) -> Column:
        position = (F.col("n") - 1) * q
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (lo + (hi - lo) * (position - F.floor(position))).alias(name)

    return ranks.select(*by, "n", *[blend(name, q) for name, q in points.items()])


def weighted_percentiles(df: DataFrame, by: list[str], value: str, weight: str, points: dict[str, float]) -> DataFrame:
    """First value whose running weight reaches ``q`` of the total, per group."""
    def at(q: float) -> Callable[[Column], Column]:
        return lambda n: n * q

    return rank_values(df.where(F.col(weight) > 0), by, value, {name: at(q) for name, q in points.items()}, weight)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, position: str = "position") -> DataFrame:
    """First ``k`` rows of each group. The filter on the row number lets Spark cut each map task's groups to k
    rows before the shuffle, so a hot group never reaches one task whole."""
    return df.withColumn(position, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(position) <= k)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (first-wins ascending, last-wins descending)."""
    return top_k(df, keys, order, 1, "_position").drop("_position")


def frequency_top_k(df: DataFrame, by: list[str], item: str, k: int, count: str = "cnt") -> DataFrame:
    """Most frequent items per group; rows are counted before anything is ranked."""
    counts = df.groupBy(*by, item).agg(F.count(F.lit(1)).alias(count))
    return top_k(counts, by, [F.desc(count), F.asc(item)], k)


def dense_rank_positions(df: DataFrame, by: list[str], score: str, ties: list[str], position: str = "rank") -> DataFrame:
    """1-based positions by descending score, then ``ties`` ascending, over groups of any size.

    Rows are numbered inside (group, score bucket) and offset by the rows of all higher buckets.
    """
    rows = df.withColumn("_bucket", value_bucket(F.col(score)))
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    above = W.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(above), F.lit(0))).drop("_rows")
    inside = W.partitionBy(*by, "_bucket").orderBy(F.desc(score), *[F.asc(t) for t in ties])
    return rows.join(offsets, [*by, "_bucket"]) \
        .withColumn(position, F.row_number().over(inside) + F.col("_offset")).drop("_bucket", "_offset")
