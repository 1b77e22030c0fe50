"""Skill strings: splitting, slugs and lookup keys."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .titles import literal_map

# Spellings that share one skill id.
SKILL_ALIASES = {
    "javascript": "javascript", "js": "javascript", "node.js": "nodejs", "nodejs": "nodejs",
    "react.js": "react", "reactjs": "react", "vue.js": "vue", "vuejs": "vue",
    "python3": "python", "py": "python", "machine learning": "machine_learning", "ml": "machine_learning",
    "deep learning": "deep_learning", "dl": "deep_learning", "artificial intelligence": "ai", "a.i.": "ai",
    "genai": "generative_ai", "generative ai": "generative_ai", "large language models": "llm", "llms": "llm",
    "amazon web services": "aws", "google cloud": "gcp", "google cloud platform": "gcp",
    "microsoft azure": "azure", "postgres": "postgresql", "mongo": "mongodb", "k8s": "kubernetes",
    "c#": "csharp", "c++": "cpp", "golang": "go",
}
# Delimiters of a skill list; the first one present is used.
DELIMITERS = [",", "|", ";", "\n"]


def skill_slug(skill: Column) -> Column:
    """Skill id of a raw skill string: alias of the text, alias of the slug, else the slug."""
    raw = F.trim(F.lower(skill))
    slug = F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9_]", "_"), "^_+|_+$", "")
    known = literal_map(SKILL_ALIASES)
    return F.coalesce(F.try_element_at(known, raw), F.try_element_at(known, slug), slug)


def collapsed_slug(skill: Column) -> Column:
    return F.regexp_replace(skill_slug(skill), "_+", "_")


def lookup_key(text: Column) -> Column:
    """Case-, space- and hyphen-insensitive key of an alias."""
    key = F.regexp_replace(F.lower(text), r"[\s\-_]+", " ")
    return F.regexp_replace(key, r"^[ .]+|[ .]+$", "")


def misread_key(text: Column) -> Column:
    """Lookup key with characters that scanning confuses folded together."""
    folded = F.translate(lookup_key(text), "i1|!0", "llllo")
    return F.replace(F.replace(folded, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def split_skills(text: Column) -> Column:
    """Array of skills from a JSON-like list or a delimited string."""
    empty = F.array().cast("array<string>")
    parsed = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    parsed = F.when(text.startswith("["), parsed)

    def tidy(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")

    split = F.array(text)
    for mark in reversed(DELIMITERS):
        split = F.when(text.contains(mark), F.split(text, "[" + mark + "]")).otherwise(split)
    return F.when(F.coalesce(F.trim(text), F.lit("")).isin("", "nan"), empty).otherwise(tidy(F.coalesce(parsed, split)))
