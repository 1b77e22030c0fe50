"""Language-model scores of the documents."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lm_scores import score_texts
from .registry import query, table
from .shared import crc_fold

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_lm_scores")
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, crc_fold("doc_id", 7) != 2, RANKS)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
