"""Skill taxonomy: name resolution, ancestor closure, category children, name similarity, soundness checks.

A taxonomy is two tables: ``skills`` (id, display, category, maps_to, prerequisites array, difficulty_tier,
is_category, load_id) and ``aliases`` (id, alias, rule), where ``rule`` is NULL, 'list' or 'case'.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.skill_text import collapsed_slug, lookup_key, misread_key, skill_slug
from .ranks import keep_one, top_k

MIN_MISREAD_LENGTH = 4


def all_aliases(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every spelling of a skill: its display name first, then its aliases, in load order."""
    own = skills.select("id", F.lower("display").alias("alias"), "load_id", F.lit(0).alias("_n"))
    more = aliases.join(skills.select("id", "load_id"), "id").select("id", "alias", "load_id", F.lit(1).alias("_n"))
    return own.unionByName(more)


def name_lookup(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, key, id): which key of which kind names which skill; the first skill loaded wins a shared key."""
    spellings = all_aliases(skills, aliases)
    keys = skills.select(F.lit("id").alias("kind"), F.col("id").alias("key"), "id", "load_id", F.lit(0).alias("_n"))
    for kind, make in (("slug", skill_slug), ("alias", lookup_key)):
        keys = keys.unionByName(spellings.select(F.lit(kind).alias("kind"), make(F.col("alias")).alias("key"), "id", "load_id", "_n"))
    return keep_one(keys, ["kind", "key"], [F.asc("load_id"), F.asc("_n")]).select("kind", "key", "id")


def resolve_names(names: DataFrame, name: str, lookup: DataFrame) -> DataFrame:
    """(name, skill_id) for every distinct name that resolves: by id, slug, collapsed slug, then alias key."""
    n = F.col(name)
    tries = names.select(name).distinct().select(name, F.explode(F.array(
        F.struct(F.lit(1).alias("step"), F.lit("id").alias("kind"), n.alias("key")),
        F.struct(F.lit(2).alias("step"), F.lit("slug").alias("kind"), skill_slug(n).alias("key")),
        F.struct(F.lit(3).alias("step"), F.lit("id").alias("kind"), collapsed_slug(n).alias("key")),
        F.struct(F.lit(4).alias("step"), F.lit("alias").alias("kind"), lookup_key(n).alias("key")))).alias("_t")).select(name, "_t.*")
    hits = tries.join(lookup, ["kind", "key"])
    return hits.groupBy(name).agg(F.min_by("id", "step").alias("skill_id"))


def resolve_or_slug(names: DataFrame, name: str, lookup: DataFrame, skills: DataFrame) -> DataFrame:
    """(name, skill_id, display, in_taxonomy): unknown names keep their slug and a title-cased display."""
    known = resolve_names(names, name, lookup).join(skills.select(F.col("id").alias("skill_id"), "display"), "skill_id")
    slug = F.when(collapsed_slug(F.col(name)) == "", F.col(name)).otherwise(collapsed_slug(F.col(name)))
    out = names.select(name).distinct().join(known, name, "left")
    return out.select(name, F.coalesce("skill_id", slug).alias("skill_id"),
                      F.coalesce("display", F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))).alias("display"),
                      F.col("skill_id").isNotNull().alias("in_taxonomy"))


def ancestors(skills: DataFrame) -> DataFrame:
    """(id, ancestor, depth): every coarser skill of a skill, cycle-safe (K05). A chain beyond the session's recursion limit fails.

    The taxonomy comes to the driver for it, its size doesn't depend on the data: where ``skills`` itself reads a CTE, Spark
    numbers the CTEs nested in a recursive one twice, and in a young session, whose numbers are low, it then reads another CTE.
    """
    spark = skills.sparkSession
    known = skills.select("id", "maps_to")
    known = spark.createDataFrame(known.collect(), known.schema)
    return spark.sql("""
        WITH RECURSIVE up (id, ancestor, depth, path) AS (
          SELECT id, maps_to, 1, array(maps_to) FROM {skills} WHERE maps_to IS NOT NULL AND maps_to <> ''
          UNION ALL
          SELECT u.id, s.maps_to, u.depth + 1, array_append(u.path, s.maps_to) FROM up u JOIN {skills} s ON s.id = u.ancestor
          WHERE s.maps_to IS NOT NULL AND s.maps_to <> '' AND NOT array_contains(u.path, s.maps_to))
        SELECT id, ancestor, depth FROM up""", skills=known)


def category_children(skills: DataFrame, closure: DataFrame, *, k: int = 4) -> DataFrame:
    """Concrete skills under each skill: nearest, then most children, then easiest, then by id."""
    fan = skills.where("maps_to IS NOT NULL").groupBy(F.col("maps_to").alias("child")).agg(F.count(F.lit(1)).alias("fan"))
    below = closure.select(F.col("ancestor").alias("id"), F.col("id").alias("child"), "depth")
    facts = skills.where(~F.col("is_category")).select(F.col("id").alias("child"), "difficulty_tier")
    rows = below.join(facts, "child").join(fan, "child", "left").withColumn("fan", F.coalesce("fan", F.lit(0).cast("long")))
    return top_k(rows, ["id"], [F.asc("depth"), F.desc("fan"), F.asc("difficulty_tier"), F.asc("child")], k).select("id", "child", "position")


def non_skill_reasons(names: DataFrame, name: str, non_skills: DataFrame) -> DataFrame:
    """(name, reason) for names that are no skills, matched as written or by slug."""
    keyed = names.select(name).distinct().withColumn("_slug", collapsed_slug(F.col(name)))
    lookup = non_skills.select(F.col("id").alias("_id"), "reason")
    direct = keyed.join(lookup, keyed[name] == lookup["_id"]).select(name, "reason", F.lit(1).alias("_step"))
    slugged = keyed.join(lookup, keyed["_slug"] == lookup["_id"]).select(name, "reason", F.lit(2).alias("_step"))
    return direct.unionByName(slugged).groupBy(name).agg(F.min_by("reason", "_step").alias("reason"))


def misread_repairs(texts: DataFrame, id_col: str, text: str, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, raw, fixed): phrases of one to three words that a scanner misread, and the skill meant.

    A phrase counts only if it is no known spelling and its folded form belongs to exactly one skill.
    """
    plain = aliases.where(F.col("rule").isNull() & (F.length("alias") >= MIN_MISREAD_LENGTH))
    index = plain.join(skills.select("id", "display"), "id").groupBy(misread_key(F.col("alias")).alias("_fold")) \
        .agg(F.min("display").alias("fixed"), F.max("display").alias("_other")).where("fixed = _other").drop("_other")
    known = all_aliases(skills, aliases).select(lookup_key(F.col("alias")).alias("_key")).distinct()
    lines = texts.select(id_col, F.explode(F.split(F.col(text), r"\n")).alias("_line"))
    words = lines.select(id_col, F.filter(F.split("_line", r"\s+"), lambda w: w != "").alias("_w"))

    def phrases(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.regexp_replace(F.array_join(F.slice("_w", i, n), " "), r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", ""))

    raw = words.select(id_col, F.explode_outer(F.concat(phrases(1), phrases(2), phrases(3))).alias("raw")).where(F.length("raw") >= MIN_MISREAD_LENGTH)
    hits = raw.withColumn("_fold", misread_key(F.col("raw"))).join(index, "_fold").withColumn("_key", lookup_key(F.col("raw")))
    return hits.join(known, "_key", "left_anti").select(id_col, "raw", "fixed").distinct()


# --- name similarity ------------------------------------------------------------------------------

def char_grams(name: Column, size: int = 3) -> Column:
    """Character n-grams inside words padded by one space."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w) - size + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(size)))))


def gram_similarity(names: DataFrame, group: list[str], *, threshold: float) -> DataFrame:
    """Pairs of left and right names of a group whose character 3-gram TF-IDF cosine reaches ``threshold``.

    ``names`` is (group..., side 'left' or 'right', name). Document frequencies are those of the group's names.
    Pairs meet only on a shared gram among each left name's heaviest ones: grams are added, heaviest first, until
    the rest cannot reach the threshold, so no qualifying pair is missed and unrelated names never meet.
    """
    unique = names.select(*group, "side", "name").distinct()
    tf = unique.select(*group, "side", "name", F.explode_outer(char_grams(F.col("name"))).alias("gram")) \
        .groupBy(*group, "side", "name", "gram").agg(F.count(F.lit(1)).alias("tf"))
    total = unique.groupBy(*group).agg(F.count(F.lit(1)).alias("docs"))
    df = tf.groupBy(*group, "gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, [*group, "gram"]).join(total, group) \
        .withColumn("w", F.col("tf") * (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0))
    one = W.partitionBy(*group, "side", "name")
    unit = weighted.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(one)))
    heavy = one.orderBy(F.desc("w"), F.asc("gram")).rowsBetween(W.unboundedPreceding, -1)
    left = unit.where("side = 'left'").withColumn("_rest", 1.0 - F.coalesce(F.sum(F.col("w") * F.col("w")).over(heavy), F.lit(0.0)))
    probes = left.where(F.col("_rest") >= threshold * threshold - 1e-9)
    right = unit.where("side = 'right'").select(*group, "gram", F.col("name").alias("right_name"), F.col("w").alias("rw"))
    candidates = probes.select(*group, "gram", F.col("name").alias("left_name")).join(right.drop("rw"), [*group, "gram"]) \
        .select(*group, "left_name", "right_name").distinct()
    lw = unit.where("side = 'left'").select(*group, F.col("name").alias("left_name"), "gram", F.col("w").alias("lw"))
    dots = candidates.join(lw, [*group, "left_name"]).join(right, [*group, "right_name", "gram"]) \
        .groupBy(*group, "left_name", "right_name").agg(F.sum(F.col("lw") * F.col("rw")).alias("similarity"))
    return dots.where(F.col("similarity") >= threshold - 1e-9)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors: the hook for embeddings supplied by the caller."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


# --- soundness ------------------------------------------------------------------------------------

def taxonomy_problems(skills: DataFrame, aliases: DataFrame, closure: DataFrame, *, max_words: int = 5) -> DataFrame:
    """(problem, id, detail): repeated ids and alias keys, missing targets, cycles, over-long aliases."""
    ids = skills.select(F.col("id").alias("_id")).distinct()
    repeated = skills.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_id").alias("problem"), "id", F.col("n").cast("string").alias("detail"))
    keys = all_aliases(skills, aliases).select("id", lookup_key(F.col("alias")).alias("detail")).distinct()
    shared = keys.groupBy("detail").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n > 1") \
        .select(F.lit("shared_alias").alias("problem"), "id", "detail")
    parents = skills.where("maps_to IS NOT NULL").select("id", F.col("maps_to").alias("detail"))
    needs = skills.select("id", F.explode("prerequisites").alias("detail"))
    missing = parents.unionByName(needs).join(ids, F.col("detail") == F.col("_id"), "left_anti").select(F.lit("missing_target").alias("problem"), "id", "detail")
    cycles = closure.where("id = ancestor").select(F.lit("cycle").alias("problem"), "id", F.col("ancestor").alias("detail"))
    long = aliases.where(F.size(F.split("alias", r"[\s\-_]+")) > max_words).select(F.lit("long_alias").alias("problem"), "id", F.col("alias").alias("detail"))
    return repeated.unionByName(shared).unionByName(missing).unionByName(cycles).unionByName(long)
