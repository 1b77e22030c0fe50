"""Learning roadmaps: missing skills with their prerequisites, in an order that can be learned."""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

# Difficulty tier -> hours, kind -> share of the hours.
TIER_HOURS = {1: (10, 25), 2: (30, 60), 3: (60, 120)}
DEFAULT_TIER = 2
HALF_KINDS = ["adjacent", "weak"]


def prerequisite_paths(skills: DataFrame) -> DataFrame:
    """(id, prerequisite, between, needed_by): every chain of prerequisites below a skill.

    ``between`` lists the skills passed on the way and ``needed_by`` the one that asks for the prerequisite directly.
    Broad fields are no prerequisites to learn, so a chain stops before them. The table depends on the taxonomy alone; a
    chain beyond the session's recursion limit fails.
    """
    broad = skills.where("is_category").select(F.col("id").alias("prerequisite"))
    edges = skills.select("id", F.explode("prerequisites").alias("prerequisite")).join(broad, "prerequisite", "left_anti").select("id", "prerequisite")
    return skills.sparkSession.sql("""
        WITH RECURSIVE down (id, prerequisite, between, needed_by, depth) AS (
          SELECT id, prerequisite, CAST(array() AS array<string>), id, 1 FROM {edges}
          UNION ALL
          SELECT d.id, e.prerequisite, array_append(d.between, d.prerequisite), d.prerequisite, d.depth + 1
          FROM down d JOIN {edges} e ON e.id = d.prerequisite WHERE NOT array_contains(d.between, e.prerequisite))
        SELECT id, prerequisite, between, needed_by FROM down""", edges=edges)


def roadmap_items(gaps: DataFrame, profile: DataFrame, skills: DataFrame, closure: DataFrame) -> DataFrame:
    """What a candidate has to learn for a role: open gaps and the prerequisites they lack.

    A chain of prerequisites stops at skills the candidate knows or implies, at broad fields and at other items. The chains
    of the taxonomy come with each open gap, so gaps and profiles are read once and meet once, by candidate.
    """
    key = ["candidate_id", "target_role"]
    chain = F.struct("prerequisite", "between", "needed_by")
    chains = prerequisite_paths(skills).groupBy(F.col("id").alias("skill_id")).agg(F.collect_list(chain).alias("_chains"))
    # Tables of the taxonomy's size, taken out of the plan: their recursion would be planned again at each use.
    chains = skills.sparkSession.createDataFrame(chains.collect(), chains.schema)
    facts = skills.select(F.col("id").alias("skill_id"), F.col("is_category").alias("_broad")).join(chains, "skill_id", "left")
    kind = F.when(F.col("status").isin("missing", "adjacent"), F.col("status")).when(F.col("gap") > 0, "weak")
    none = F.array().cast("array<string>")
    open_ = gaps.join(facts, "skill_id", "left").where(~F.coalesce("_broad", F.lit(False)) & kind.isNotNull())
    item = F.struct("skill_id", kind.alias("kind"), "importance", F.col("position").cast("int").alias("position"), none.alias("required_for"))
    pulls = F.when(kind != "weak", F.transform("_chains", lambda c: F.struct(c["prerequisite"].alias("skill_id"), c["between"].alias("between"), c["needed_by"].alias("needed_by"), F.col("importance").alias("importance"))))
    sets = open_.groupBy(*key).agg(F.collect_list(item).alias("_roots"), F.flatten(F.collect_list(pulls)).alias("_pulls"))
    above = closure.groupBy(F.col("id").alias("skill_id")).agg(F.collect_set("ancestor").alias("_above"))
    above = skills.sparkSession.createDataFrame(above.collect(), above.schema)
    known = profile.select("candidate_id", "skill_id").join(above, "skill_id", "left") \
        .select("candidate_id", F.explode(F.concat(F.array("skill_id"), F.coalesce("_above", none))).alias("skill_id")).groupBy("candidate_id").agg(F.collect_set("skill_id").alias("_known"))
    barred = F.array_union(F.coalesce("_known", none), F.transform("_roots", lambda r: r["skill_id"]))
    met = sets.join(known, "candidate_id", "left").select(*key, "_roots", "_pulls", barred.alias("_barred"))
    needed = met.select(*key, "_roots", F.filter("_pulls", lambda c: ~F.arrays_overlap(F.array_append(c["between"], c["skill_id"]), F.col("_barred"))).alias("_pulls"))

    def pulled(skill: Column) -> Column:
        asked = F.filter("_pulls", lambda c: c["skill_id"] == skill)
        return F.struct(skill.alias("skill_id"), F.lit("prerequisite").alias("kind"), F.array_max(F.transform(asked, lambda c: c["importance"])).alias("importance"),
                        F.lit(1_000_000).alias("position"), F.array_sort(F.array_distinct(F.transform(asked, lambda c: c["needed_by"]))).alias("required_for"))

    added = F.transform(F.array_distinct(F.transform("_pulls", lambda c: c["skill_id"])), pulled)
    return needed.select(*key, F.inline_outer(F.concat("_roots", added)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def learning_order(ranks: pd.Series, positions: pd.Series, ids: pd.Series, needs: pd.Series) -> pd.Series:
    """Places of a request's items in the order to learn them: of the items whose needs are placed, the one with the lowest
    (rank, position, id) is next. Items in a circle of needs have no place.

    Needs that are no items of the request count as met. Each item enters the heap once and each need is met once.
    """
    def order(rank, position, names, need) -> list[int]:
        place = {}
        for i, name in enumerate(names):
            place.setdefault(name, []).append(i)
        left, wanted_by = [0] * len(names), {}
        for i, deps in enumerate(need):
            for d in set(deps) & place.keys():
                left[i] += len(place[d])
                for j in place[d]:
                    wanted_by.setdefault(j, []).append(i)
        rank = [(0, 0.0) if r is None or r != r else (1, r) for r in rank]  # no importance comes first, as a null does
        entry = lambda i: (rank[i], position[i], names[i], i)
        ready = [entry(i) for i, n in enumerate(left) if not n]
        heapq.heapify(ready)
        out = []
        while ready:
            i = heapq.heappop(ready)[-1]
            out.append(i)
            for j in wanted_by.get(i, ()):
                left[j] -= 1
                if not left[j]:
                    heapq.heappush(ready, entry(j))
        return out

    return pd.Series([order(list(r), list(p), list(n), list(d)) for r, p, n, d in zip(ranks, positions, ids, needs)])


def ordered_roadmap(items: DataFrame, skills: DataFrame, *, hours_per_week: float | None = None, limit: int | None = None) -> DataFrame:
    """Milestones in order: prerequisites first, then importance, then position; with hours and weeks.

    ``limit`` shows the first milestones only; ``omitted`` then has how many are left out, and the total hours are those
    of the milestones shown. A request's items are one list, ordered in n log n steps; they carry all their columns, so
    nothing is joined back.
    """
    key = ["candidate_id", "target_role"]
    facts = skills.select(F.col("id").alias("skill_id"), F.coalesce("prerequisites", F.array().cast("array<string>")).alias("_needs"), "difficulty_tier")
    rows = items.join(facts, "skill_id", "left")
    carried = [c for c in rows.columns if c not in (*key, "_needs")]
    sets = rows.groupBy(*key).agg(F.collect_list(F.struct(*carried, F.coalesce("_needs", F.array().cast("array<string>")).alias("_needs"))).alias("_items"))
    part = lambda f: F.transform("_items", f)
    order = learning_order(part(lambda x: -x["importance"].cast("double")), part(lambda x: x["position"]), part(lambda x: x["skill_id"]), part(lambda x: x["_needs"]))
    ordered = sets.select(*key, "_items", order.alias("_order"))
    shown = F.col("_order") if limit is None else F.slice("_order", 1, limit)
    placed = ordered.select(*key, (F.size("_order") - F.size(shown)).alias("omitted"), F.posexplode_outer(F.transform(shown, lambda i: F.get("_items", i))).alias("_pos", "_item")) \
        .where("_item IS NOT NULL").select(*key, "omitted", (F.col("_pos") + 1).alias("order"), *[F.col(f"_item.{c}") for c in carried])
    tier = F.coalesce("difficulty_tier", F.lit(DEFAULT_TIER))
    factor = F.when(F.col("kind").isin(HALF_KINDS), 0.5).otherwise(1.0)

    def hours(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for t, h in TIER_HOURS.items() for x in (t, float(h[i]))])
        return F.bround(F.try_element_at(table, tier) * factor, 0).cast("int")

    timed = placed.withColumn("hours_low", hours(0)).withColumn("hours_high", hours(1))
    if hours_per_week:
        run = W.partitionBy(*key).orderBy("order").rowsBetween(W.unboundedPreceding, 0)
        for side in ("low", "high"):
            timed = timed.withColumn(f"weeks_{side}", F.ceil(F.sum(f"hours_{side}").over(run) / hours_per_week).cast("int"))
    whole = W.partitionBy(*key)
    return timed.drop("position").withColumn("total_hours_low", F.sum("hours_low").over(whole)).withColumn("total_hours_high", F.sum("hours_high").over(whole))
