"""Table sinks and exports. Keyed writes settle the key before anything is written, so a lost executor repeats them safely."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.ranks import dense_rank_positions, keep_one


def write_table(df: DataFrame, path: str, *, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Parquet sink (S22): append rows or replace the table. Keyed writes go through ``merge_keyed`` to a new path."""
    writer = df.write.mode("overwrite" if mode == "replace" else "append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merge_keyed(old: DataFrame | None, new: DataFrame, *, keys: list[str], order: str, keep: str) -> DataFrame:
    """Old and new rows with one row per key: the first seen (insert-or-ignore) or the last (insert-or-replace)."""
    rows = new.withColumn("_gen", F.lit(1)) if old is None else old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    direction = (F.asc("_gen"), F.asc(order)) if keep == "first" else (F.desc("_gen"), F.desc(order))
    return keep_one(rows, keys, list(direction)).drop("_gen")


def replace_markets(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the snapshot of every market present in ``df`` and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def occupation_documents(occupations: DataFrame, requirements: DataFrame) -> DataFrame:
    """One nested document per occupation: header, counts by kind and its requirements, most important first."""
    item = F.struct((-F.coalesce("importance_norm", F.lit(0.0))).alias("o"), "item_type", "item_name", "importance_norm")
    nested = requirements.groupBy("soc_code").agg(F.array_sort(F.collect_list(item)).alias("_r"), F.count(F.lit(1)).alias("total_requirements"))
    listed = F.transform("_r", lambda x: F.struct(x["item_type"].alias("item_type"), x["item_name"].alias("item_name"), x["importance_norm"].alias("importance_norm")))
    body = F.to_json(F.struct("soc_code", "title", "total_requirements", listed.alias("requirements")))
    return occupations.join(nested, "soc_code").select("soc_code", "title", "total_requirements", body.alias("document")) \
        .withColumn("sha256", F.sha2("document", 256))


def document_parts(requirements: DataFrame, *, size: int = 1000) -> DataFrame:
    """(soc_code, part, items, lines, sha256): an occupation's requirements as JSON lines, most important first, in parts of
    ``size`` lines (S23).

    Places are counted per range of the importance, so an occupation of any size is neither sorted nor held in one task;
    its document is the lines of its parts in order. A missing importance counts as 0 and is written as null.
    """
    rows = requirements.select("soc_code", "item_type", "item_name", "importance_norm", F.coalesce("importance_norm", F.lit(0.0)).alias("score"))
    placed = dense_rank_positions(rows, ["soc_code"], "score", ["item_type", "item_name"], "place")
    shown = F.when(F.col("importance_norm").isNotNull(), F.format_string("%.4f", "importance_norm")).alias("importance")
    line = F.to_json(F.struct("item_type", "item_name", shown), {"ignoreNullFields": "false"})
    parts = placed.groupBy("soc_code", F.floor((F.col("place") - 1) / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return parts.select("soc_code", "part", F.size("lines").cast("long").alias("items"), text.alias("lines")).withColumn("sha256", F.sha2("lines", 256))


def document_manifest(occupations: DataFrame, parts: DataFrame) -> DataFrame:
    """(soc_code, title, parts, items, sha256): what a reader needs to put an occupation's parts together and check them."""
    whole = parts.groupBy("soc_code").agg(F.count(F.lit(1)).alias("parts"), F.sum("items").alias("items"), F.array_sort(F.collect_list(F.struct("part", "sha256"))).alias("_d"))
    return occupations.select("soc_code", "title").join(whole, "soc_code").select(
        "soc_code", "title", "parts", "items", F.sha2(F.array_join(F.transform("_d", lambda x: x["sha256"]), ""), 256).alias("sha256"))


def table_counts(tables: dict[str, DataFrame], *, version: str) -> DataFrame:
    """One row of build metadata: version and a JSON map of row counts."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n"))))
    return counts.agg(F.to_json(pairs).alias("table_counts")).select(F.lit(version).alias("schema_version"), "table_counts")


def latest_build(metadata: DataFrame) -> DataFrame:
    return metadata.orderBy(F.desc("schema_version")).limit(1)
