"""Rates that mix the documents to target weights."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import fit_rates, memberships, train
from .registry import query, table

#: Domains of the labelled table and the share of tokens that each should have.
DOMAINS = ["good", "low", "toxic"]
TARGETS = [0.97, 0.02, 0.01]


def domain() -> Column:
    """The domain of a labelled document: toxic before low quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", domain().alias("domain"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, labelled(spark, sf_dir), DOMAINS)
    rated = fit_rates(memberships(docs, model).drop("text"), TARGETS)
    return rated.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")
