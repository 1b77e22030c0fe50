"""Secrets in the documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .secrets import PATTERNS, scan, spelled


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind, _ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(spelled("base_spans").cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
