"""Quality scores of the documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_model import score, train
from .registry import query, table
from .shared import crc_fold

#: A score below this is a rejection.
ACCEPTED = 0.3
FOLDS = 5


def learned_from(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.where(crc_fold("doc_id", FOLDS) != 0)


def predicted(score_column: str = "score"):
    return (F.col(score_column) >= ACCEPTED).cast("int")


@query("op3_quality_model")
def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, learned_from(table(spark, sf_dir, "labels")))
    return score(docs, forest).select("doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "score", predicted().alias("predicted"))
