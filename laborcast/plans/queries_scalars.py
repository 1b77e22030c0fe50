"""Scalar cleaning over the postings lens."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, places, posting_text, skill_text, titles
from .catalog import query
from .lenses import lens

SENIOR = "sr\\.?|jr\\.?|senior|junior|lead|principal|staff|chief"


def title_sql(column: str, words: str = SENIOR) -> str:
    """The title rules as DuckDB text."""
    t = f"trim(lower({column}))"
    t = rf"regexp_replace({t}, '\s*[\(\[].*?[\)\]]', '', 'g')"
    t = rf"regexp_replace({t}, '\s*({words})\s*', ' ', 'g')"
    t = rf"regexp_replace({t}, '\s*(i|ii|iii|iv|v|1|2|3)\s*$', '', 'g')"
    t = rf"regexp_replace({t}, '[^a-z0-9\s]', '', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def match_key_sql(column: str) -> str:
    return title_sql(column, SENIOR + "|head|associate|assistant")


def case_sql(subject: str, rules: list[tuple[list[str], str]], default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({subject}, '{n}')" for n in needles) + f" THEN {out}"
                     for needles, out in rules)
    return f"CASE {whens} ELSE {default} END"


def map_sql(key: str, pairs: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def initcap_sql(text: str) -> str:
    return (f"array_to_string(list_transform(string_split({text}, ' '), "
            f"lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ')")


def slug_sql(text: str) -> str:
    raw = f"trim(lower({text}))"
    slug = f"regexp_replace(regexp_replace({raw}, '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"coalesce({map_sql(raw, skill_text.SKILL_ALIASES)}, {map_sql(slug, skill_text.SKILL_ALIASES)}, {slug})"


@query("b01_normalize_title", f"SELECT posting_id, title, {title_sql('title')} AS title_normalized FROM raw_postings")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", "title", titles.normalize_title(F.col("title")).alias("title_normalized"))


@query("b02_title_match_key", f"SELECT posting_id, {match_key_sql('''concat('Assistant ', title)''')} AS match_key FROM raw_postings")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select(
        "posting_id", titles.title_match_key(F.concat(F.lit("Assistant "), "title")).alias("match_key"))


@query("b03_normalize_skill", f"SELECT posting_id, skill_name, {slug_sql('skill_name')} AS skill_normalized FROM posting_skills")
def _(spark, sf):
    return lens(spark, sf, "posting_skills").select(
        "posting_id", "skill_name", skill_text.skill_slug(F.col("skill_name")).alias("skill_normalized"))


LAKH = r"(\d+\.?\d*)\s*[-–to]+\s*(\d+\.?\d*)\s*(lacs?|lakhs?|lpa)"
PLAIN = r"(\d{5,})\s*[-–to]+\s*(\d{5,})"


@query("b04_inr_salary", rf"""
WITH s AS (SELECT posting_id, lower(trim(regexp_replace(salary_text, '[,₹]', '', 'g'))) AS t FROM raw_postings)
SELECT posting_id,
  CASE WHEN regexp_matches(t, '{LAKH}') THEN try_cast(regexp_extract(t, '{LAKH}', 1) AS DOUBLE) * 100000
       ELSE try_cast(regexp_extract(t, '{PLAIN}', 1) AS DOUBLE) END AS salary_min_inr,
  CASE WHEN regexp_matches(t, '{LAKH}') THEN try_cast(regexp_extract(t, '{LAKH}', 2) AS DOUBLE) * 100000
       ELSE try_cast(regexp_extract(t, '{PLAIN}', 2) AS DOUBLE) END AS salary_max_inr
FROM s""")
def _(spark, sf):
    s = numbers.inr_salary(F.col("salary_text"))
    return lens(spark, sf, "raw_postings").select("posting_id", s["min"].alias("salary_min_inr"), s["max"].alias("salary_max_inr"))


@query("b05_positive_number", """
SELECT posting_id, CASE WHEN v > 0 THEN v END AS amount FROM (
  SELECT posting_id, try_cast(trim(regexp_replace(number_text, '[,$₹]', '', 'g')) AS DOUBLE) AS v FROM raw_postings)""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", numbers.positive_number(F.col("number_text")).alias("amount"))


@query("b06_year_month", r"""
WITH d AS (SELECT posting_id, trim(date_text) AS s FROM raw_postings),
e AS (SELECT *, CASE WHEN regexp_full_match(s, '\d{10,}') THEN
        CASE WHEN CAST(s AS DOUBLE) > 1e12 THEN CAST(s AS DOUBLE) / 1000 ELSE CAST(s AS DOUBLE) END END AS secs FROM d)
SELECT posting_id,
  CASE WHEN secs IS NOT NULL THEN CAST(year(make_timestamp(CAST(secs * 1000000 AS BIGINT))) AS INT)
       WHEN regexp_matches(s, '^(\d{4})-(\d{1,2})') THEN CAST(regexp_extract(s, '^(\d{4})-(\d{1,2})', 1) AS INT)
       ELSE try_cast(regexp_extract(s, '^(\d{1,2})[/-](\d{1,2})[/-](\d{4})', 3) AS INT) END AS listed_year,
  CASE WHEN secs IS NOT NULL THEN CAST(month(make_timestamp(CAST(secs * 1000000 AS BIGINT))) AS INT)
       WHEN regexp_matches(s, '^(\d{4})-(\d{1,2})') THEN CAST(regexp_extract(s, '^(\d{4})-(\d{1,2})', 2) AS INT)
       ELSE try_cast(regexp_extract(s, '^(\d{1,2})[/-](\d{1,2})[/-](\d{4})', 2) AS INT) END AS listed_month
FROM e""")
def _(spark, sf):
    ym = dates.year_month(F.col("date_text"))
    return lens(spark, sf, "raw_postings").select("posting_id", ym["year"].alias("listed_year"), ym["month"].alias("listed_month"))


@query("b07_years_range", r"""
SELECT posting_id,
  CASE WHEN regexp_matches(experience_text, '(\d+\.?\d*)\s*[-–to]+\s*(\d+\.?\d*)')
       THEN try_cast(regexp_extract(experience_text, '(\d+\.?\d*)\s*[-–to]+\s*(\d+\.?\d*)', 1) AS DOUBLE)
       ELSE try_cast(regexp_extract(experience_text, '(\d+\.?\d*)\+?', 1) AS DOUBLE) END AS experience_min,
  try_cast(regexp_extract(experience_text, '(\d+\.?\d*)\s*[-–to]+\s*(\d+\.?\d*)', 2) AS DOUBLE) AS experience_max
FROM raw_postings""")
def _(spark, sf):
    y = numbers.years_range(F.col("experience_text"))
    return lens(spark, sf, "raw_postings").select("posting_id", y["min"].alias("experience_min"), y["max"].alias("experience_max"))


COUNTRY = [(marks, f"'{name}'") for name, marks in places.COUNTRY_RULES]


@query("b08_guess_country", f"""
SELECT posting_id, CASE WHEN location = '' THEN 'Unknown' ELSE {case_sql('lower(location)', COUNTRY, "'Other'")} END AS country
FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", places.guess_country(F.col("location")).alias("country"))


SPLIT_SQL = """
CASE WHEN trim(skills_text) IN ('', 'nan') THEN [] ELSE list_filter(list_transform(
  CASE WHEN contains(skills_text, ',') THEN string_split(skills_text, ',')
       WHEN contains(skills_text, '|') THEN string_split(skills_text, '|')
       WHEN contains(skills_text, ';') THEN string_split(skills_text, ';') ELSE [skills_text] END,
  lambda x: trim(x)), lambda x: x <> '') END"""


@query("b09_split_skills", f"""
SELECT posting_id, array_to_string(skills, '~') AS skills, CAST(len(skills) AS BIGINT) AS n_skills
FROM (SELECT posting_id, {SPLIT_SQL} AS skills FROM skill_lists)""")
def _(spark, sf):
    s = skill_text.split_skills(F.col("skills_text"))
    return lens(spark, sf, "skill_lists").select("posting_id", F.array_join(s, "~").alias("skills"), F.size(s).cast("long").alias("n_skills"))


@query("b10_inr_to_usd", "SELECT posting_id, round(nullif(salary_min, 0) * 0.012::DOUBLE, 2) AS salary_min_usd FROM raw_postings")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", numbers.inr_to_usd(F.col("salary_min")).alias("salary_min_usd"))


@query("b11_city_part", """
SELECT posting_id, CASE WHEN trim(location) = '' THEN 'India' ELSE trim(split_part(location, ',', 1)) END AS city FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", places.city_part(F.col("location")).alias("city"))


@query("b12_parse_number", """
SELECT posting_id, coalesce(try_cast(trim(number_text) AS DOUBLE), 0.0::DOUBLE) AS as_double,
  CAST(trunc(try_cast(trim(number_text) AS DOUBLE)) AS INT) AS as_int FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select(
        "posting_id", numbers.parse_number(F.col("number_text")).alias("as_double"),
        numbers.parse_int(F.col("number_text")).alias("as_int"))


@query("b13_rating_norms", """
SELECT soc_code, element, load_id, round(greatest(0.0, least(1.0, (importance - 1) / 4)), 4) AS importance_norm,
  round(greatest(0.0, least(1.0, level / 7)), 4) AS level_norm FROM rating_groups""")
def _(spark, sf):
    return lens(spark, sf, "rating_groups").select(
        "soc_code", "element", "load_id", numbers.importance_norm(F.col("importance")).alias("importance_norm"),
        numbers.level_norm(F.col("level")).alias("level_norm"))


RANGE = r"(\d{1,2}(?:\.\d)?)\s*(?:-|–|to)\s*(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)"
LEAST = (r"(?:minimum\s+(?:of\s+)?)?(\d{1,2}(?:\.\d)?)\s*\+\s*(?:years?|yrs?)"
         r"|(?:minimum|min\.?|at least)\s+(?:of\s+)?(\d{1,2}(?:\.\d)?)\s*(?:years?|yrs?)")
YEARS_OF = r"(\d{1,2}(?:\.\d)?)\s*(?:years?|yrs?)(?:\s+of)?\s+(?:relevant\s+|professional\s+|work\s+)?experience"


@query("b14_posting_years", rf"""
WITH g AS (SELECT posting_id, try_cast(regexp_extract(lower(description), '{RANGE}', 1) AS DOUBLE) AS lo,
    try_cast(regexp_extract(lower(description), '{RANGE}', 2) AS DOUBLE) AS hi,
    try_cast(coalesce(nullif(regexp_extract(lower(description), '{LEAST}', 1), ''),
      nullif(regexp_extract(lower(description), '{LEAST}', 2), ''), regexp_extract(lower(description), '{YEARS_OF}', 1)) AS DOUBLE) AS one
  FROM raw_postings)
SELECT posting_id, CASE WHEN lo <= hi AND hi <= 40 THEN lo WHEN one <= 40 THEN one END AS experience_min,
  CASE WHEN lo <= hi AND hi <= 40 THEN hi END AS experience_max FROM g""")
def _(spark, sf):
    y = numbers.posting_years(F.col("description"))
    return lens(spark, sf, "raw_postings").select("posting_id", y["min"].alias("experience_min"), y["max"].alias("experience_max"))


MODE_SQL = r"""CASE WHEN contains(lower(description), 'hybrid') THEN 'hybrid'
 WHEN regexp_matches(lower(description), '\b(remote|work from home|wfh)\b') THEN 'remote'
 WHEN regexp_matches(lower(description), '\b(on-?site|in-?office|work from office)\b') THEN 'onsite' ELSE 'unknown' END"""


@query("b15_work_mode", f"""
SELECT posting_id, CASE WHEN is_remote THEN 'remote' ELSE {MODE_SQL} END AS flagged_mode, {MODE_SQL} AS text_mode FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select(
        "posting_id", posting_text.work_mode(F.col("description"), F.col("is_remote")).alias("flagged_mode"),
        posting_text.work_mode(F.col("description")).alias("text_mode"))


@query("b16_description_quality", """
SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'missing' WHEN length(trim(text)) < 200 THEN 'short' ELSE 'ok' END AS quality
FROM documents""")
def _(spark, sf):
    return lens(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", posting_text.description_quality(F.col("text")).alias("quality"))


@query("b17_plausible_salary", """
SELECT posting_id, CASE WHEN round_even(salary_min * 50, 0) BETWEEN 50000 AND 20000000 THEN CAST(round_even(salary_min * 50, 0) AS BIGINT) END AS yearly
FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", numbers.plausible_salary(F.col("salary_min") * 50).alias("yearly"))


@query("b18_posted_timestamp", r"""
SELECT posting_id, strftime(CASE WHEN regexp_full_match(date_text, '\d+') THEN make_timestamp(CAST(date_text AS BIGINT) * 1000000)
    WHEN regexp_matches(iso, '^\d{4}-') THEN CAST(replace(replace(iso, 'T', ' '), 'Z', '') AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS posted
FROM (SELECT posting_id, date_text, CASE posting_id % 5 WHEN 1 THEN concat('2024-03-0', CAST(1 + posting_id % 9 AS VARCHAR), 'T10:15:00Z') ELSE '' END AS iso FROM raw_postings)""")
def _(spark, sf):
    rows = lens(spark, sf, "raw_postings").withColumn(
        "text", F.when(F.col("posting_id") % 5 == 1, F.concat(F.lit("2024-03-0"), (1 + F.col("posting_id") % 9).cast("string"), F.lit("T10:15:00Z")))
        .otherwise(F.col("date_text")))
    return rows.select("posting_id", F.date_format(dates.posted_timestamp(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query("b19_employment_type", r"""
SELECT posting_id, CASE WHEN regexp_matches(lower(title), '\bintern(ship)?\b') THEN 'internship'
    WHEN contract_time IS NOT NULL THEN contract_time WHEN contract_type = 'contract' THEN 'contract'
    WHEN contract_type = 'permanent' THEN 'full_time' ELSE 'unknown' END AS employment_type,
  CASE posting_id % 3 WHEN 0 THEN 'full_time' WHEN 1 THEN 'contract' ELSE 'unknown' END AS employment_from_codes
FROM raw_postings""")
def _(spark, sf):
    rows = lens(spark, sf, "raw_postings").withColumn(
        "codes", F.when(F.col("posting_id") % 3 == 0, F.array(F.lit("other"), F.lit("fulltime")))
        .when(F.col("posting_id") % 3 == 1, F.array(F.lit("CONTRACTOR"))).otherwise(F.array(F.lit("x"))))
    return rows.select("posting_id", posting_text.employment_type(F.col("title"), F.col("contract_time"), F.col("contract_type")).alias("employment_type"),
                       posting_text.employment_from_codes(F.col("title"), F.col("codes")).alias("employment_from_codes"))


@query("b20_salary_currency", """
SELECT posting_id, CASE WHEN coalesce(currency_code, '') <> '' THEN upper(currency_code)
    WHEN contains(currency_text, '$') OR contains(upper(currency_text), 'USD') THEN 'USD'
    WHEN contains(currency_text, '€') OR contains(currency_text, '£') THEN 'OTHER' ELSE 'INR' END AS currency
FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", posting_text.salary_currency(F.col("currency_code"), F.col("currency_text")).alias("currency"))


@query("b21_yearly_amount", """
WITH f AS (SELECT posting_id, CASE upper(coalesce(period, 'YEAR')) WHEN 'YEAR' THEN 1 WHEN 'MONTH' THEN 12 END AS factor, salary_min, salary_max FROM raw_postings),
y AS (SELECT posting_id, round_even(salary_max * factor, 0) AS a, round_even(salary_min * factor, 0) AS b FROM f),
z AS (SELECT posting_id, CASE WHEN a BETWEEN 50000 AND 20000000 THEN CAST(a AS BIGINT) END AS a, CASE WHEN b BETWEEN 50000 AND 20000000 THEN CAST(b AS BIGINT) END AS b FROM y)
SELECT posting_id, CASE WHEN a > b THEN b ELSE a END AS yearly_min, CASE WHEN a > b THEN a ELSE b END AS yearly_max FROM z""")
def _(spark, sf):
    # The upper figure is passed first, so that the swap is exercised.
    p = numbers.ordered_pair(numbers.yearly_amount(F.col("salary_max"), F.col("period")), numbers.yearly_amount(F.col("salary_min"), F.col("period")))
    return lens(spark, sf, "raw_postings").select("posting_id", p["min"].alias("yearly_min"), p["max"].alias("yearly_max"))


NOISE = "pvt|private|ltd|limited|inc|llp|llc|corp|corporation|co|india|technologies|technology|solutions|services"


def plain_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '\b({NOISE})\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


DUPLICATE_KEY_SQL = f"sha1(concat({plain_sql('title')}, '|', {plain_sql('company')}, '|', {plain_sql('location')}))"


@query("b22_duplicate_key", f"SELECT posting_id, {DUPLICATE_KEY_SQL} AS duplicate_key FROM raw_postings")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select(
        "posting_id", posting_text.duplicate_key(F.col("title"), F.col("company"), F.col("location")).alias("duplicate_key"))


def city_sql(text: str) -> str:
    key = rf"regexp_replace(lower(trim({text})), '\s+', ' ', 'g')"
    first = f"trim(split_part({key}, ',', 1))"
    return f"CASE WHEN trim({text}) <> '' THEN coalesce({map_sql(key, places.CITY_ALIASES)}, {map_sql(first, places.CITY_ALIASES)}, {initcap_sql(first)}) END"


def profile_city_sql(text: str) -> str:
    first = f"trim(split_part({text}, ',', 1))"
    key = rf"regexp_replace(lower({first}), '\s+', ' ', 'g')"
    return f"CASE WHEN trim({text}) <> '' THEN coalesce({map_sql(key, places.PROFILE_CITY_ALIASES)}, {initcap_sql(first)}) END"


@query("b23_normalize_city", f"SELECT posting_id, {city_sql('location')} AS city, {profile_city_sql('location')} AS profile_city FROM raw_postings")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select(
        "posting_id", places.normalize_city(F.col("location")).alias("city"), places.profile_city(F.col("location")).alias("profile_city"))


EXPAND_SQL = """CASE WHEN city = 'Delhi NCR' THEN ['Delhi', 'Noida', 'Gurugram'] WHEN city IS NULL THEN [] ELSE [city] END"""


@query("b24_expand_city", f"""
SELECT posting_id, unnest({EXPAND_SQL}) AS city FROM (SELECT posting_id, {city_sql('raw_city')} AS city FROM raw_postings)""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", F.explode(places.expand_city(F.col("raw_city"))).alias("city"))


@query("b25_city_from_path", f"""
SELECT posting_id, coalesce({city_sql("list_extract(list_filter(list_reverse(p), lambda x: lower(trim(x)) IN (" + ", ".join(f"'{k}'" for k in places.CITY_ALIASES) + ")), 1)")},
   {city_sql('p[-1]')}) AS city
FROM (SELECT posting_id, ['India', raw_city, occupation] AS p FROM raw_postings)""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select(
        "posting_id", places.city_from_path(F.array(F.lit("India"), F.col("raw_city"), F.col("occupation"))).alias("city"))


def _rules(i: int) -> list[tuple[list[str], str]]:
    return [(r[0], f"'{r[i]}'" if isinstance(r[i], str) else str(r[i])) for r in places.CITY_RULES]


def canonical_city_sql(city: str, i: int) -> str:
    tidy = initcap_sql(rf"regexp_replace(trim({city}), '^[-\s]+', '')")
    return case_sql(f"lower(trim({city}))", _rules(i), {1: tidy, 2: "'Other'", 3: "3", 4: tidy}[i])


@query("b26_canonical_city", f"""
SELECT posting_id, {canonical_city_sql('raw_city', 1)} AS city_canonical, {canonical_city_sql('raw_city', 2)} AS state,
  {canonical_city_sql('raw_city', 3)} AS tier, {canonical_city_sql('raw_city', 4)} AS metro_group FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", places.canonical_city(F.col("raw_city")).alias("c")).select("posting_id", "c.*")


@query("b27_canonical_code", """
SELECT posting_id, CASE WHEN length(c) = 7 AND NOT contains(c, '.') THEN concat(c, '.00') ELSE c END AS soc_code
FROM (SELECT posting_id, trim(CASE WHEN posting_id % 2 = 0 THEN substr(soc_code, 1, 7) ELSE soc_code END) AS c FROM raw_postings)""")
def _(spark, sf):
    rows = lens(spark, sf, "raw_postings")
    short = F.when(F.col("posting_id") % 2 == 0, F.substring("soc_code", 1, 7)).otherwise(F.col("soc_code"))
    return rows.select("posting_id", titles.canonical_code(short).alias("soc_code"))


GROUP_SQL = ", ".join(
    "coalesce(" + map_sql("substr(soc_code, 1, 2)", {k: v[i] for k, v in titles.MAJOR_GROUPS.items()}) + f", '{titles.DEFAULT_GROUP[i]}') AS {n}"
    for i, n in enumerate(["major_group_title", "career_cluster", "local_industry"]))


@query("b28_major_group", f"SELECT posting_id, substr(soc_code, 1, 2) AS soc_major_group, {GROUP_SQL} FROM raw_postings")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", titles.major_group(F.col("soc_code")).alias("g")).select("posting_id", "g.*")


@query("b29_item_slug", """
SELECT posting_id, skill_name, concat('tech_', lower(replace(replace(replace(replace(replace(skill_name, ' ', '_'), '/', '_'), '-', '_'), '(', ''), ')', ''))) AS item_id
FROM posting_skills""")
def _(spark, sf):
    return lens(spark, sf, "posting_skills").select("posting_id", "skill_name", titles.item_slug("tech", F.col("skill_name")).alias("item_id"))


KEY_SQL = r"regexp_replace(regexp_replace(lower(title), '[\s\-_]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"


@query("b30_lookup_keys", rf"""
SELECT posting_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, {KEY_SQL} AS lookup_key,
  replace(replace(translate({KEY_SQL}, 'i1|!0', 'llllo'), 'rn', 'm'), 'vv', 'w') AS misread_key FROM raw_postings""")
def _(spark, sf):
    t = F.col("title")
    return lens(spark, sf, "raw_postings").select("posting_id", titles.word_slug(t).alias("slug"), skill_text.lookup_key(t).alias("lookup_key"),
                                                  skill_text.misread_key(t).alias("misread_key"))


@query("b31_round_to_step", """
SELECT posting_id, CAST(floor(salary_max / 10000 + 0.5) * 10000 AS BIGINT) AS to_10k, CAST(floor(salary_max / 50000 + 0.5) * 50000 AS BIGINT) AS to_50k
FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", numbers.round_to_step(F.col("salary_max"), 10_000).alias("to_10k"),
                                                  numbers.round_to_step(F.col("salary_max"), 50_000).alias("to_50k"))


def lakhs_sql(amount: str) -> str:
    return rf"regexp_replace(printf('%.1f', ({amount})::DOUBLE / 100000), '\.0$', '')"


@query("b32_lakhs_text", f"""
SELECT posting_id, {lakhs_sql('lo')} AS lakhs, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN concat({lakhs_sql('lo')}, '-', {lakhs_sql('hi')}, ' LPA') END AS lakhs_range
FROM (SELECT posting_id, CAST(floor(salary_min / 10000) * 10000 AS BIGINT) AS lo, CAST(floor(salary_max / 10000) * 10000 AS BIGINT) AS hi FROM raw_postings)""")
def _(spark, sf):
    rows = lens(spark, sf, "raw_postings").select(
        "posting_id", (F.floor(F.col("salary_min") / 10000) * 10000).alias("lo"), (F.floor(F.col("salary_max") / 10000) * 10000).alias("hi"))
    return rows.select("posting_id", F.when(F.col("lo").isNotNull(), numbers.lakhs(F.col("lo"))).alias("lakhs"),
                       numbers.lakhs_range(F.col("lo"), F.col("hi")).alias("lakhs_range"))


NOW = "2024-01-31 00:00:00"


@query("b33_age", rf"""
WITH a AS (SELECT event_id, round(greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 / 3600), 1) AS h FROM events)
SELECT event_id, h AS age_hours, CASE WHEN h < 1 THEN concat('fetched ', CAST(CAST(round_even(h * 60, 0) AS INT) AS VARCHAR), ' min ago')
  ELSE concat('fetched ', regexp_replace(printf('%.1f', h), '\.0$', ''), ' h ago') END AS age_text FROM a""")
def _(spark, sf):
    hours = dates.age_hours(F.col("ts"), F.lit(NOW).cast("timestamp"))
    return lens(spark, sf, "SELECT event_id, ts FROM events").select("event_id", hours.alias("age_hours")) \
        .withColumn("age_text", dates.age_text(F.col("age_hours")))


@query("b34_display_name", f"""
SELECT posting_id, skill_normalized, coalesce({map_sql('lower(skill_normalized)', titles.DISPLAY_NAMES)}, {initcap_sql("replace(skill_normalized, '_', ' ')")}) AS display,
  CASE WHEN length(skill_normalized) <= 3 THEN upper(skill_normalized) ELSE replace(skill_normalized, '_', ' ') END AS readable
FROM skill_mentions""")
def _(spark, sf):
    s = F.col("skill_normalized")
    return lens(spark, sf, "skill_mentions").select("posting_id", "skill_normalized", titles.display_name(s).alias("display"), titles.readable(s).alias("readable"))


@query("b35_strip_contacts", r"""
SELECT posting_id, regexp_replace(description, '(?i)\S+@\S+|(?:https?://|www\.)\S+|\b(?:linkedin|github|gitlab|kaggle|leetcode|medium)[.\s]com\S*', ' ', 'g') AS text
FROM raw_postings""")
def _(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", posting_text.strip_contacts(F.col("description")).alias("text"))


@query("b36_next_rung", r"""
SELECT posting_id, CASE WHEN w = '' THEN concat('Senior ', trim(t)) WHEN w IN ('senior', 'sr') THEN concat('Lead ', b) WHEN w = 'lead' THEN concat('Principal ', b) END AS next_role
FROM (SELECT posting_id, t, regexp_replace(lower(regexp_extract(t, '(?i)^\s*(senior|sr\.?|lead|principal)\s+', 1)), '\.$', '') AS w,
        regexp_replace(t, '(?i)^\s*(?:senior|sr\.?|lead|principal)\s+', '') AS b
      FROM (SELECT posting_id, CASE WHEN posting_id % 9 = 0 THEN concat('Principal ', occupation) ELSE title END AS t FROM raw_postings))""")
def _(spark, sf):
    t = F.when(F.col("posting_id") % 9 == 0, F.concat(F.lit("Principal "), "occupation")).otherwise(F.col("title"))
    return lens(spark, sf, "raw_postings").select("posting_id", titles.next_rung(t).alias("next_role"))


def band_sql(title: str, bands, i: int, default: str) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches(lower({title}), '\b({b[0]})\b') THEN {b[i]}" for b in bands) + f" ELSE {default} END::DOUBLE"


@query("b37_title_band", f"""
SELECT posting_id, {band_sql('title', titles.POSTING_TITLE_BANDS, 1, 'NULL')} AS posting_lo, {band_sql('title', titles.POSTING_TITLE_BANDS, 2, 'NULL')} AS posting_hi,
  {band_sql('title', titles.GAP_TITLE_BANDS, 1, '0.0')} AS gap_lo, {band_sql('title', titles.GAP_TITLE_BANDS, 2, '5.0')} AS gap_hi FROM raw_postings""")
def _(spark, sf):
    t = F.col("title")
    a, b = titles.title_band(t), titles.title_band(t, titles.GAP_TITLE_BANDS, titles.GAP_DEFAULT_BAND)
    return lens(spark, sf, "raw_postings").select("posting_id", a["min"].alias("posting_lo"), a["max"].alias("posting_hi"),
                                                  b["min"].alias("gap_lo"), b["max"].alias("gap_hi"))


@query("b38_fingerprint", "SELECT doc_id, sha1(text) AS fingerprint FROM documents")
def _(spark, sf):
    return lens(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", posting_text.fingerprint(F.col("text")).alias("fingerprint"))
