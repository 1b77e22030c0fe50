"""Personal data in the documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .personal import KINDS, scan, spelled, train
from .registry import query, table


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(spelled("base_spans").cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
