"""Free-text titles resolved to occupation codes, and occupation search."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.places import canonical_city
from ..functions.titles import first_two_words, title_match_key
from .containment import any_token_join, contains_join
from .ranks import keep_one, top_k

# Codes a title must not be sent to, and the words that forbid it.
CONFLICTS = {
    "17-2051.00": ["software", "developer", "java", "python", "programming", "frontend", "backend", "full stack"],
    "47-2111.00": ["software", "developer", "frontend", "backend"],
}
ALTERNATE_CONFIDENCE, OFFICIAL_CONFIDENCE = 0.95, 0.90


def title_dictionary(aliases: DataFrame, alternates: DataFrame, occupations: DataFrame) -> DataFrame:
    """(title_key, soc_code, confidence, method, priority): one row per key and source.

    Aliases (raw_title, soc_code, confidence, load_id) and official titles (title, soc_code, load_id) keep the
    last row of a key, alternates (title, soc_code, load_id) the first.
    """
    alias = keep_one(aliases.select(title_match_key(F.col("raw_title")).alias("title_key"), "soc_code", "confidence", "load_id"),
                     ["title_key"], [F.desc("load_id")])
    alternate = keep_one(alternates.select(title_match_key(F.col("title")).alias("title_key"), "soc_code", "load_id")
                         .where("title_key <> ''"), ["title_key"], [F.asc("load_id")])
    official = keep_one(occupations.select(title_match_key(F.lower("title")).alias("title_key"), "soc_code", "load_id"),
                        ["title_key"], [F.desc("load_id")])

    def row(df: DataFrame, confidence: Column, method: str, priority: int) -> DataFrame:
        return df.select("title_key", "soc_code", confidence.alias("confidence"), F.lit(method).alias("method"),
                         F.lit(priority).alias("priority"), "load_id")

    return row(alias, F.col("confidence"), "alias_exact", 1) \
        .unionByName(row(alternate, F.lit(ALTERNATE_CONFIDENCE), "alternate_exact", 2)) \
        .unionByName(row(official, F.lit(OFFICIAL_CONFIDENCE), "official_exact", 3))


def prefix_confidence(key: Column, target: Column) -> Column:
    """0.55-0.90 by shared words between a title and the dictionary entry its prefix hit."""
    a, b = F.array_distinct(F.split(key, " ")), F.array_distinct(F.split(target, " "))
    shared = F.size(F.array_intersect(a, b))
    jaccard = shared / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    overlap = shared / F.greatest(F.size(a), F.lit(1))
    return F.greatest(F.lit(0.50), F.least(F.lit(0.90), F.round(0.55 + 0.35 * (0.6 * jaccard + 0.4 * overlap), 3)))


def without_conflicts(df: DataFrame, key: str, code: str = "soc_code") -> DataFrame:
    """Drops matches that send a software title to a construction or trade code."""
    bad = F.lit(False)
    for c, words in CONFLICTS.items():
        bad = bad | ((F.col(code) == c) & F.col(key).rlike("|".join(words)))
    return df.where(~bad)


def resolve_titles(titles: DataFrame, title: str, dictionary: DataFrame) -> DataFrame:
    """(title, soc_code, confidence, method) for every distinct title that resolves.

    Exact hits win by source priority; otherwise the first two words are looked up, aliases first, then the
    first dictionary entry that starts with them. Titles are resolved once each, however many rows share them.
    """
    keyed = titles.select(title).distinct().withColumn("title_key", title_match_key(F.col(title))).where("title_key <> ''")
    best = keep_one(dictionary, ["title_key"], [F.asc("priority")])
    exact = keyed.join(best, "title_key").select(title, "soc_code", "confidence", "method")
    rest = keyed.join(best.select("title_key"), "title_key", "left_anti").withColumn("prefix", first_two_words(F.col("title_key"))) \
        .where("prefix IS NOT NULL")
    alias = dictionary.where("priority = 1").select(F.col("title_key").alias("prefix"), "soc_code", F.col("title_key").alias("target"),
                                                   F.lit("alias_prefix_match").alias("method"), F.lit(0).alias("rank"))
    starts = dictionary.withColumn("prefix", first_two_words(F.col("title_key"))).where("prefix IS NOT NULL")
    starts = keep_one(starts, ["prefix"], [F.asc("priority"), F.asc("load_id"), F.asc("title_key")]).select(
        "prefix", "soc_code", F.col("title_key").alias("target"), F.lit("prefix_match").alias("method"), F.lit(1).alias("rank"))
    lookup = keep_one(alias.unionByName(starts), ["prefix"], [F.asc("rank")])
    hits = without_conflicts(rest.join(lookup, "prefix"), "title_key")
    partial = hits.select(title, "soc_code", prefix_confidence(F.col("title_key"), F.col("target")).alias("confidence"), "method")
    return exact.unionByName(partial)


def apply_codes(rows: DataFrame, title: str, resolved: DataFrame) -> DataFrame:
    """Rows with the code of their title; unresolved rows drop out."""
    return rows.join(resolved, title)


def postings_with_city(postings: DataFrame, code_map: DataFrame) -> DataFrame:
    """Postings joined to their code and to the canonical form of their city."""
    cities = postings.select("city").where(F.coalesce("city", F.lit("")) != "").distinct() \
        .select("city", canonical_city(F.col("city")).alias("_c")).select("city", "_c.*")
    return postings.join(code_map, "posting_id").join(cities, "city", "left")


def query_tokens(text: Column) -> Column:
    """Words of three or more letters of a free-text query."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""))
    return F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 2)


def domain_search(requests: DataFrame, occupations: DataFrame, *, k: int = 10) -> DataFrame:
    """Top occupations of each (request, query) whose title or description has any query word."""
    asked = requests.select("request", query_tokens(F.col("query")).alias("tokens"))
    titles = occupations.select("soc_code", "title", "description", F.concat_ws("\n", F.lower("title"), F.lower("description")).alias("_text"))
    hits = any_token_join(asked, "request", "tokens", titles, "_text")
    found = hits.join(asked, "request").join(titles, "_text")
    relevance = F.when(F.lower("title").contains(F.get("tokens", F.lit(0))), 3.0).otherwise(1.0)
    rows = found.select("request", "soc_code", "title", relevance.alias("relevance"))
    return top_k(rows, ["request"], [F.desc("relevance"), F.asc(F.length("title")), F.asc("title")], k) \
        .withColumn("relevance_score", F.least(F.round(F.col("relevance") * 0.35 + 0.50, 2), F.lit(0.98)))


def best_occupation(queries: DataFrame, occupations: DataFrame) -> DataFrame:
    """Best occupation per query: equal title, title containing it, title containing all its words; the shortest
    title wins inside a stage (T03, T08). ``queries`` is (query,)."""
    q = queries.select("query").distinct().withColumn("_q", F.lower(F.trim("query"))).where("_q <> ''")
    occ = occupations.select("soc_code", "title", F.lower("title").alias("_t"))
    part = contains_join(q, "_q", occ, "_t")
    near = q.join(part, "_q").select("query", "_t", F.when(F.col("_q") == F.col("_t"), 1).otherwise(2).alias("stage"))
    words = q.select("query", query_tokens(F.col("query")).alias("tokens"))
    all_words = any_token_join(words, "query", "tokens", occ, "_t").join(words, "query") \
        .where(F.col("hits") == F.size(F.array_distinct("tokens"))).select("query", "_t", F.lit(3).alias("stage"))
    hits = near.unionByName(all_words).join(occ, "_t")
    return keep_one(hits, ["query"], [F.asc("stage"), F.asc(F.length("title")), F.asc("title")]).select("query", "soc_code", "title", "stage")


# The confidence of each search stage.
SEARCH_STAGES = {"alias_exact": 1.0, "title_exact": 1.0, "alternate_exact": 0.95, "alias_partial": 0.90,
                 "title_partial": 0.88, "alternate_partial": 0.82, "token_match": 0.70}


def _stage_rows(df: DataFrame, stage: int, method: str, confidence: Column, size: Column) -> DataFrame:
    return df.select("query", "soc_code", "title", F.lit(stage).alias("stage"), F.lit(method).alias("method"),
                     F.round(confidence, 2).alias("confidence"), F.col("matched_term"), size.alias("_size"))


def search_titles(queries: DataFrame, occupations: DataFrame, aliases: DataFrame, alternates: DataFrame, *, k: int = 5) -> DataFrame:
    """Top ``k`` occupations per free-text query over seven stages.

    Exact stages upgrade a lower confidence. Each partial stage offers its ``k`` shortest terms and only adds
    occupations while fewer than ``k`` were found before it. ``aliases``: raw_title, soc_code, confidence;
    ``alternates``: title, soc_code.
    """
    q = queries.select("query").distinct().withColumn("_q", F.lower(F.trim("query"))).where("_q <> ''")
    occ = occupations.select("soc_code", "title")
    named = {
        "alias": aliases.select("soc_code", F.col("raw_title").alias("matched_term"), "confidence").join(occ, "soc_code"),
        "title": occ.withColumn("matched_term", F.col("title")).withColumn("confidence", F.lit(1.0)),
        "alternate": alternates.select("soc_code", F.col("title").alias("matched_term")).join(occ, "soc_code").withColumn("confidence", F.lit(1.0)),
    }
    terms = [df.select(F.lit(name).alias("kind"), "soc_code", "title", "matched_term", "confidence", F.lower("matched_term").alias("_t"))
             for name, df in named.items()]
    terms = terms[0].unionByName(terms[1]).unionByName(terms[2])
    hits = q.join(contains_join(q, "_q", terms, "_t"), "_q").join(terms, "_t")
    kind, exact = F.col("kind"), F.col("_t") == F.col("_q")
    order = {"alias": (1, 4), "title": (2, 5), "alternate": (3, 6)}
    score = {"alias": (F.col("confidence"), F.col("confidence") * SEARCH_STAGES["alias_partial"]),
             "title": (F.lit(1.0), F.lit(SEARCH_STAGES["title_partial"])),
             "alternate": (F.lit(SEARCH_STAGES["alternate_exact"]), F.lit(SEARCH_STAGES["alternate_partial"]))}
    # A hit is a row of its partial stage and, if it is exact, of its exact stage; the hits are made once.
    pick = lambda i, values: reduce(lambda acc, n: F.when(kind == n, values(n)).otherwise(acc), order, F.lit(None))
    stages = [F.struct(pick(i, lambda n: F.lit(order[n][i])).alias("stage"), pick(i, lambda n: F.lit(f"{n}_{word}")).alias("method"),
                       F.round(pick(i, lambda n: score[n][i].cast("double")), 2).alias("confidence")) for i, word in enumerate(("exact", "partial"))]
    both = F.when(exact, F.array(*stages)).otherwise(F.array(stages[1]))
    parts = [hits.select("query", "soc_code", "title", "matched_term", F.length("matched_term").alias("_size"), F.inline(both))
             .select("query", "soc_code", "title", "stage", "method", "confidence", "matched_term", "_size")]
    words = q.select("query", query_tokens(F.col("query")).alias("tokens"))
    lowered = occ.withColumn("_t", F.lower("title"))
    by_word = any_token_join(words, "query", "tokens", lowered, "_t").join(lowered, "_t").withColumn("matched_term", F.col("title"))
    parts.append(_stage_rows(by_word, 7, "token_match", F.lit(SEARCH_STAGES["token_match"]), F.length("matched_term")))
    rows = parts[0].unionByName(parts[1])
    # Exact alias and title hits are all offered; every later stage offers the k shortest of its terms.
    size = W.partitionBy("query", "stage").orderBy(F.asc("_size"), F.asc("matched_term"), F.asc("soc_code"))
    offered = rows.withColumn("_pos", F.row_number().over(size)).where((F.col("stage") <= 2) | (F.col("_pos") <= k)).drop("_pos")
    ranked = keep_one(offered, ["query", "soc_code", "stage"], [F.desc("confidence"), F.asc("_size"), F.asc("matched_term")])
    own, before = W.partitionBy("query", "soc_code"), W.partitionBy("query").orderBy("stage").rangeBetween(W.unboundedPreceding, -1)
    new = F.col("stage") == F.col("_first")
    firsts = ranked.withColumn("_first", F.min("stage").over(own)).withColumn("_before", F.coalesce(F.sum(new.cast("int")).over(before), F.lit(0)))
    open_ = firsts.withColumn("_open", F.max(new & ((F.col("stage") <= 3) | (F.col("_before") < k))).over(own))
    chosen = open_.where(F.col("_open") & ((F.col("stage") <= 3) | new))
    best = keep_one(chosen, ["query", "soc_code"], [F.desc("confidence"), F.asc("stage")])
    return top_k(best, ["query"], [F.desc("confidence"), F.asc("stage"), F.asc("_size"), F.asc("soc_code")], k) \
        .select("query", "soc_code", "title", "method", "confidence", "matched_term", "position")
