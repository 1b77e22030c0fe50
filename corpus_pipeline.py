"""From raw documents to token ids: quality, near duplicates, secrets, mixture, encoding.

Every stage takes what the one before kept, reads whole texts and returns the columns of documents; the last returns the
encoded documents. A stage is one operator of ``laborcast.llm`` and the decision taken on its result.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborcast.llm import bpe, mixing, quality_model, secrets, simhash
from laborcast.llm.queries_bpe import VOCABULARY
from laborcast.llm.queries_mixing import DOMAINS, TARGETS, labelled
from laborcast.llm.queries_quality_model import ACCEPTED, learned_from
from laborcast.llm.registry import table
from laborcast.llm.shared import checkpoint_folder

TOTAL, KEEP = 1.1, 0.1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects: a score below ACCEPTED.

    The classifier learns from the labels outside the held-out fold, on the documents that have one.
    """
    forest = quality_model.train(docs, learned_from(table(spark, sf_dir, "labels")))
    return quality_model.score(docs, forest, name="__score").where(F.col("__score") >= ACCEPTED).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id; of equal rows one.

    Groups are what links of texts reach whose sets of five-word shingles have a similarity of 0.8 or more: SimHash tables
    give the first pairs, an exact join the others (:func:`laborcast.llm.simhash.deduplicated`).
    """
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mask, and n_chars by the new length where the text changed."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")  # columns of the scan's names stay apart
    clean = secrets.redact(secrets.scan(wrapped).withColumn("__changed", F.size("spans") > 0))
    length = F.when(F.col("__changed"), F.length("text")).otherwise(F.col("__row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": length}
    return clean.select(*[new.get(c, F.col(f"__row.`{c}`")).cast(kind).alias(c) for c, kind in docs.dtypes])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each document as its rate says, once at most: the domains come near their target weights by what is left out.

    The earlier stages have left little of the unwanted domains, and what the classifier isn't sure of is spread over good
    documents; so rates are held near one (KEEP), and the total is a little above the tokens there are (TOTAL), so that
    good documents have rates of one or more and stay. Of the others a part stays.
    """
    model = mixing.train(docs, labelled(spark, sf_dir), DOMAINS)
    keyed = docs.withColumn("__id", F.xxhash64("doc_id", "text"))
    members = mixing.memberships(keyed.select("__id", "text"), model).drop("text")  # the fit writes these, so without texts
    rates = mixing.fit_rates(members, TARGETS, total=TOTAL, keep=KEEP).select("__id", F.col("rate").alias("__rate")).dropDuplicates(["__id"])
    return mixing.copies(keyed.join(rates, "__id"), docs.columns, rate="__rate", most=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of each document; the digest is of the text decoded from the ids."""
    encoded = bpe.encode(docs, VOCABULARY)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixture", mixture), ("encoding", encoding)]
#: The classifiers and the fingerprints are beyond SQL; the tests check each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the checkpoint folder as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
