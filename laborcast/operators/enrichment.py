"""Skills of documents kept up to date: only what is new, changed, or touched by a changed alias is extracted again.

Stored rows hold a document's fingerprint and its skills. A run compares fingerprints, and the aliases of this run with those
of the last; the texts are walked once with the changed aliases alone, which is far less than an extraction, to find the
documents whose text spells one. All other stored rows are carried over.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .textmine import alias_mentions, skill_hits


def text_fingerprint(text: Column) -> Column:
    """The text as its SHA-256; a missing text counts as an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def changed_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, alias, rule) that only one of two taxonomies has."""
    rows = [df.select("id", "alias", "rule") for df in (old, new)]
    return rows[0].exceptAll(rows[1]).unionByName(rows[1].exceptAll(rows[0])).distinct()


def stale_documents(docs: DataFrame, stored: DataFrame, id_col: str, text: str, skills: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(id, reason) of the documents to extract again: ``new``, ``text`` (the stored fingerprint is another) or ``alias``.

    Overlaps are settled inside a document, so an alias that is gone, added or ruled otherwise can only matter where it is
    spelled; what rules and overlaps then make of it is left to the extraction.
    """
    keyed = docs.select(id_col, text_fingerprint(F.col(text)).alias("_now"))
    met = keyed.join(stored.select(id_col, F.col("fingerprint").alias("_stored")), id_col, "left")
    reason = F.when(F.col("_stored").isNull(), "new").when(F.col("_stored") != F.col("_now"), "text")
    if changed is None:
        return met.select(id_col, reason.alias("reason")).where("reason IS NOT NULL")
    spelled = alias_mentions(docs, id_col, text, skills, changed, F.lit(False)).select(id_col).distinct().withColumn("_alias", F.lit("alias"))
    return met.join(spelled, id_col, "left").select(id_col, F.coalesce(reason, "_alias").alias("reason")).where("reason IS NOT NULL")


def extracted(docs: DataFrame, id_col: str, text: str, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, fingerprint, skills) of documents: their skills by id, an empty list where there are none."""
    hits = skill_hits(docs, id_col, text, skills, aliases).groupBy(id_col).agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))
    return docs.select(id_col, text_fingerprint(F.col(text)).alias("fingerprint")).join(hits, id_col, "left") \
        .withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def refreshed(docs: DataFrame, stored: DataFrame, id_col: str, text: str, skills: DataFrame, aliases: DataFrame, last_aliases: DataFrame | None = None) -> DataFrame:
    """(id, fingerprint, skills, reason): what a full extraction gives, with the reason where a document was extracted again.

    ``stored`` has (id, fingerprint, skills), one row a document; rows of documents that are gone are left out. ``last_aliases``
    are those of the stored rows; without them only texts are compared. ``skills`` must have all ids of both taxonomies.
    """
    changed = None if last_aliases is None else changed_aliases(last_aliases, aliases)
    stale = stale_documents(docs, stored, id_col, text, skills, changed)
    again = extracted(docs.join(stale, id_col, "left_semi"), id_col, text, skills, aliases).join(stale, id_col)
    present = docs.select(id_col).join(stale, id_col, "left_anti")
    kept = stored.join(present, id_col, "left_semi").select(id_col, "fingerprint", "skills", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(again)
