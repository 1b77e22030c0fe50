"""Views that read the provided tables as labour-market data.

Each lens is one SELECT in SQL that Spark and DuckDB both run, so a check compares two implementations of an
operator over the same rows. Text between engines differs only where a tuple (spark, duckdb) is given. Lenses
keep every row of the tables they read.
"""
from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def values(rows: list[tuple], columns: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def _renamed(column: str) -> str:
    """Part names read as job titles: the adjective becomes a field, the noun a trade."""
    for old, new in [("blue", "cloud"), ("cold", "clinical"), ("hot", "kitchen"), ("large", "industrial"),
                     ("new", "graduate"), ("old", "heritage"), ("red", "field"), ("small", "local"),
                     ("anvil", "electrician"), ("bolt", "nurse"), ("gear", "civil engineer"),
                     ("gizmo", "data scientist"), ("plate", "chef"), ("ring", "data entry clerk"),
                     ("rod", "truck driver"), ("widget", "software developer")]:
        column = f"replace({column}, '{old}', '{new}')"
    return column


def _code(title: str) -> str:
    """Occupation code of a renamed title: the trade gives the group, the field the last digit."""
    trade = "CASE " + " ".join(f"WHEN {title} LIKE '%{t}' THEN '{c}'" for t, c in [
        ("electrician", "47-211"), ("nurse", "29-114"), ("civil engineer", "17-205"), ("data scientist", "15-205"),
        ("chef", "35-101"), ("data entry clerk", "43-902"), ("truck driver", "53-303"),
        ("software developer", "15-125")]) + " ELSE '99-999' END"
    field = "CASE " + " ".join(f"WHEN {title} LIKE '{f}%' THEN '{i}.00'" for i, f in enumerate(
        ["cloud", "clinical", "kitchen", "industrial", "graduate", "heritage", "field", "local"])) + " ELSE '9.00' END"
    return f"concat({trade}, {field})"


CITY_NAMES = ["Bangalore", "bengaluru, karnataka", "Navi Mumbai", "Toronto, Canada", "New Delhi", "Gurgaon", "London",
              "Greater Noida", "Hyderabad", "Berlin, Germany", "Pune", "Remote", "Chennai", "San Jose, CA", "Kolkata",
              "delhi ncr", "Jaipur", "Mysuru", "Austin, TX", "Kochi", "- surat", "Thane", "munich", "Vancouver",
              "Anywhere in India"]
# Raw skill spellings asked for by postings; position = part key modulo the list length.
SKILL_NAMES = ["Python", "JS", "Machine Learning", "node.js", "C++", "SQL", "data", "Power BI", "R", "aws", "K8s",
               "Communication", "gender", "Deep Learning", "Postgres", "React.js", "Docker", "kubernetes", "Java",
               "management", "Excel", "Tally", "patient care", "nursing", "AutoCAD", "wiring", "python3", "ML",
               "devops", "tableau", "spark", "hadoop", "git", "linux", "c", "go", "GenAI", "azure", "google cloud",
               "bonus", "level 2"]
TASK_VERBS = ["Record and file", "Analyze", "Install and repair", "Transcribe", "Design and test", "Negotiate over",
              "Compile", "Review", "Assemble", "Prescribe or recommend drug", "Discuss", "Inspect"]
TASK_OBJECTS = ["billing logs", "statistical models", "wiring and circuit equipment", "patient vital signs",
                "software programs", "customer contracts", "data entry tickets", "401(k) and IRS form data",
                "machinery and hand tools", "quarterly plans"]
# Document words that stand for skills: (skill id, alias seen in the documents).
WORD_ALIASES = [
    ("python", "thatin"), ("sql", "ononst"), ("java", "rewh"), ("aws", "inoran"), ("docker", "hehely"),
    ("machine_learning", "orantion of"), ("machine_learning", "orantion"), ("react", "orre"), ("nodejs", "elle"),
    ("kubernetes", "eux"), ("r", "ble"), ("go", "ung"), ("excel", "nci"), ("tableau", "ment de"),
    ("tableau", "ment"), ("git", "eau"), ("linux", "ing the"), ("spark", "ier"), ("nursing", "tre"),
    ("hadoop", "oi"), ("pandas", "aux"), ("statistics", "tion and"), ("postgresql", "ai en"),
]


def _word(vocab: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(vocab)) + " END"


def _sql() -> dict[str, str | tuple[str, str]]:
    title, code = _renamed("p_name"), _code("title")
    return {
        "occupations": f"""
            SELECT title, {code} AS soc_code,
                   concat('Plan and carry out the work of a ', title, ' and report results') AS description
            FROM (SELECT DISTINCT {title} AS title FROM part) t""",
        "parts_coded": f"""
            SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, title AS occupation, {code} AS soc_code
            FROM (SELECT *, {title} AS title FROM part) t""",
        "postings": """
            SELECT o.o_orderkey AS posting_id,
              concat(CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Senior ' WHEN '2-HIGH' THEN 'Lead '
                     WHEN '5-LOW' THEN 'Jr. ' ELSE '' END, p.occupation,
                     CASE o.o_orderstatus WHEN 'P' THEN ' (Remote)' WHEN 'F' THEN ' II' ELSE '' END) AS title,
              p.occupation, p.soc_code, c.c_name AS company, n.n_name AS city, c.c_nationkey AS nationkey,
              c.c_custkey AS custkey,
              CASE WHEN r.r_name = 'ASIA' THEN 'india' ELSE 'global' END AS region,
              CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_totalprice * 0.8 END AS salary_min,
              CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_totalprice * 1.2 END AS salary_max,
              CAST(CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE p.p_size % 12 END AS DOUBLE) AS experience_min,
              CAST(CASE WHEN o.o_orderkey % 6 = 0 OR o.o_orderkey % 13 = 0 THEN NULL
                        ELSE p.p_size % 12 + 3 END AS DOUBLE) AS experience_max,
              CAST(CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE year(o.o_orderdate) + 24 END AS INT) AS listed_year,
              month(o.o_orderdate) AS listed_month,
              o.o_orderdate AS posted_at
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
            JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
            JOIN parts_coded p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)""",
        "city_names": values(list(enumerate(CITY_NAMES)), "nationkey, raw_city"),
        "skill_names": values(list(enumerate(SKILL_NAMES)), "k, skill_name"),
        # Spark deals the lines by posting before the distinct, so that what is grouped or joined by posting later stays there.
        "posting_skills": (
            f"""
            SELECT DISTINCT l.posting_id, s.skill_name
            FROM (SELECT /*+ REPARTITION(posting_id) */ l_orderkey AS posting_id, CAST(l_partkey % {len(SKILL_NAMES)} AS INT) AS k FROM lineitem) l
            JOIN skill_names s ON s.k = l.k""",
            f"""
            SELECT DISTINCT l.l_orderkey AS posting_id, s.skill_name
            FROM lineitem l JOIN skill_names s ON s.k = l.l_partkey % {len(SKILL_NAMES)}"""),
        "skill_lists": (
            "SELECT posting_id, array_join(array_sort(collect_list(skill_name)), "
            "CASE posting_id % 3 WHEN 0 THEN ', ' WHEN 1 THEN '|' ELSE ' ; ' END) AS skills_text "
            "FROM posting_skills GROUP BY posting_id",
            "SELECT posting_id, CASE posting_id % 3 WHEN 0 THEN array_to_string(s, ', ') "
            "WHEN 1 THEN array_to_string(s, '|') ELSE array_to_string(s, ' ; ') END AS skills_text "
            "FROM (SELECT posting_id, list_sort(list(skill_name)) AS s FROM posting_skills GROUP BY posting_id)"),
        "raw_postings": """
            SELECT p.posting_id, p.region, p.title, p.occupation, p.soc_code, p.posted_at, p.listed_year,
              concat(p.company, CASE p.posting_id % 4 WHEN 0 THEN ' Pvt. Ltd' WHEN 1 THEN ' Technologies'
                     WHEN 2 THEN ', Inc.' ELSE '' END) AS company,
              CASE WHEN p.posting_id % 17 = 0 THEN '' ELSE concat(c.raw_city,
                     CASE p.posting_id % 3 WHEN 0 THEN ', India' ELSE '' END) END AS location,
              c.raw_city,
              CASE p.posting_id % 5
                WHEN 0 THEN concat(CAST(2 + p.posting_id % 9 AS STRING), '-', CAST(6 + p.posting_id % 9 AS STRING), ' Lacs PA')
                WHEN 1 THEN concat('₹1,5', CAST(p.posting_id % 10 AS STRING), '0,000 - 2,25,000 P.A')
                WHEN 2 THEN 'Not disclosed'
                WHEN 3 THEN concat(CAST(3 + p.posting_id % 7 AS STRING), '.25 to ', CAST(9 + p.posting_id % 7 AS STRING), '.5 Lakhs')
                ELSE NULL END AS salary_text,
              CASE p.posting_id % 4
                WHEN 0 THEN concat(CAST(p.posting_id % 8 AS STRING), '-', CAST(3 + p.posting_id % 8 AS STRING), ' Yrs')
                WHEN 1 THEN concat(CAST(p.posting_id % 15 AS STRING), '+ years') WHEN 2 THEN 'Fresher' ELSE NULL END AS experience_text,
              CASE p.posting_id % 5
                WHEN 0 THEN concat('1', lpad(CAST(p.posting_id * 7919 % 1000000000 AS STRING), 9, '0'))
                WHEN 1 THEN concat(CAST(year(p.posted_at) AS STRING), '-', CAST(month(p.posted_at) AS STRING), '-5T00:00')
                WHEN 2 THEN concat('15/', CAST(month(p.posted_at) AS STRING), '/', CAST(year(p.posted_at) AS STRING))
                WHEN 3 THEN 'yesterday' ELSE '' END AS date_text,
              CASE p.posting_id % 5 WHEN 0 THEN concat('$', CAST(p.posting_id % 900 AS STRING), ',500')
                WHEN 1 THEN '-12' WHEN 2 THEN 'n/a' WHEN 3 THEN concat(' ₹', CAST(p.posting_id AS STRING), '.5 ') ELSE NULL END AS number_text,
              concat(p.title, ' wanted. ',
                CASE p.posting_id % 6 WHEN 0 THEN concat(CAST(1 + p.posting_id % 5 AS STRING), ' to ', CAST(4 + p.posting_id % 5 AS STRING), ' years in a similar role.')
                  WHEN 1 THEN concat('Minimum ', CAST(p.posting_id % 9 AS STRING), ' yrs needed.')
                  WHEN 2 THEN concat(CAST(p.posting_id % 12 AS STRING), '+ years.')
                  WHEN 3 THEN concat(CAST(p.posting_id % 6 AS STRING), ' years of relevant experience.')
                  WHEN 4 THEN 'Between 12 - 4 years, at least 3 years.' ELSE '' END,
                CASE p.posting_id % 7 WHEN 0 THEN ' Hybrid team.' WHEN 1 THEN ' Work from home.' WHEN 2 THEN ' On-site only.'
                  WHEN 3 THEN ' Remote friendly.' ELSE ' Join us.' END,
                CASE p.posting_id % 3 WHEN 0 THEN ' Master''s degree or B.Tech.' WHEN 1 THEN ' Any graduate; write to jobs@example.com or www.example.com/apply.' ELSE '' END) AS description,
              CASE p.posting_id % 5 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' ELSE NULL END AS contract_time,
              CASE p.posting_id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'permanent' ELSE NULL END AS contract_type,
              CASE p.posting_id % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'inr' ELSE NULL END AS currency_code,
              CASE p.posting_id % 8 WHEN 0 THEN '$90K a year' WHEN 1 THEN '€50,000' WHEN 2 THEN '5 LPA' ELSE NULL END AS currency_text,
              CASE p.posting_id % 4 WHEN 0 THEN 'YEAR' WHEN 1 THEN 'month' WHEN 2 THEN 'HOUR' ELSE NULL END AS period,
              p.posting_id % 9 = 0 AS is_remote,
              CAST(p.salary_min AS DOUBLE) AS salary_min, CAST(p.salary_max AS DOUBLE) AS salary_max,
              p.experience_min, p.experience_max, p.listed_month, p.custkey, p.nationkey
            FROM postings p JOIN city_names c ON c.nationkey = p.nationkey""",
        "skill_mentions": """
            SELECT s.skill_name,
              CASE lower(s.skill_name) WHEN 'js' THEN 'javascript' WHEN 'node.js' THEN 'nodejs' WHEN 'c++' THEN 'cpp'
                WHEN 'k8s' THEN 'kubernetes' WHEN 'postgres' THEN 'postgresql' WHEN 'react.js' THEN 'react'
                WHEN 'python3' THEN 'python' WHEN 'ml' THEN 'machine_learning' WHEN 'genai' THEN 'generative_ai'
                WHEN 'google cloud' THEN 'gcp' ELSE replace(lower(s.skill_name), ' ', '_') END AS skill_normalized,
              p.region, CASE p.region WHEN 'india' THEN 'boards' ELSE 'network' END AS source,
              coalesce(p.listed_year, 2024) AS year, p.listed_month AS month, 1 AS frequency,
              p.occupation AS occupation_context, p.soc_code, p.posting_id
            FROM posting_skills s JOIN postings p ON p.posting_id = s.posting_id""",
        "tasks": f"""
            SELECT soc_code, occupation, p_partkey AS load_id, concat('T', CAST(p_partkey AS STRING)) AS task_id,
              concat({_word(TASK_VERBS, "p_partkey % 12")}, ' ', {_word(TASK_OBJECTS, "p_size % 10")}, ' for ',
                     lower(p_brand)) AS task_description,
              CAST(p_size AS DOUBLE) AS importance
            FROM parts_coded""",
        "rating_groups": """
            SELECT p.soc_code, g.l_linenumber AS element, g.l_partkey AS load_id,
              1 + 40 * g.max_discount AS importance, g.max_quantity / 8 AS level, g.n,
              CASE WHEN g.l_partkey % 50 = 0 THEN 'Y' ELSE 'N' END AS suppress,
              CASE WHEN g.l_partkey % 77 = 0 THEN 'Y' ELSE '' END AS not_relevant
            FROM (SELECT l_partkey, l_linenumber, max(l_discount) AS max_discount, max(l_quantity) AS max_quantity,
                         count(*) AS n FROM lineitem GROUP BY l_partkey, l_linenumber) g
            JOIN parts_coded p ON p.p_partkey = g.l_partkey""",
        "ratings": """
            SELECT soc_code, concat('2.A.', CAST(element AS STRING)) AS element_id,
              concat('Element ', CAST(element AS STRING)) AS element_name, 'IM' AS scale_id,
              importance AS data_value, n, suppress, not_relevant, load_id FROM rating_groups
            UNION ALL
            SELECT soc_code, concat('2.A.', CAST(element AS STRING)), concat('Element ', CAST(element AS STRING)), 'LV',
              level, n, suppress, not_relevant, load_id FROM rating_groups WHERE load_id % 9 <> 0""",
        "content_model": values([(f"2.A.{i}", f"What element {i} means") for i in range(1, 6)], "element_id, description"),
        "title_aliases": values([
            ("staff nurse", "29-1141.00", 1.0), ("nurse", "29-1141.00", 0.95), ("clinical nurse", "29-1140.00", 0.9),
            ("civil engineer", "17-2050.00", 1.0), ("site engineer", "17-2051.00", 1.0),
            ("data scientist", "15-2051.00", 1.0), ("cloud data", "15-2050.00", 0.95),
            ("electrician", "47-2111.00", 1.0), ("industrial truck", "53-3033.00", 0.9), ("chef", "35-1011.00", 1.0),
            ("heritage civil", "17-2051.00", 1.0)], "raw_title, soc_code, confidence"),
        "alternate_titles": """
            SELECT soc_code, concat(lower(p_type), ' ', occupation) AS title, min(p_partkey) AS load_id
            FROM parts_coded GROUP BY soc_code, concat(lower(p_type), ' ', occupation)
            UNION ALL
            SELECT soc_code, concat(occupation, ' ', lower(p_type)), min(p_partkey) + 1000000000
            FROM parts_coded GROUP BY soc_code, concat(occupation, ' ', lower(p_type))""",
        "posting_stream_source": """
            SELECT event_id, ts, user_id, event_type AS role, value * 10000 AS salary, props FROM events""",
    }


@lru_cache(maxsize=1)
def lens_sql() -> dict[str, str | tuple[str, str]]:
    from . import lens_extra

    return {**_sql(), **lens_extra.lens_sql()}


def _text(name: str, engine: str) -> str:
    sql = lens_sql()[name]
    text = sql if isinstance(sql, str) else sql[0 if engine == "spark" else 1]
    return text if engine == "spark" else text.replace(" AS STRING)", " AS VARCHAR)")


def _needed(sql: str, engine: str) -> list[str]:
    """Lenses a query reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in lens_sql():
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*(?:AS|\.|\())", text):
                visit(_text(name, engine))
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_lenses(sql: str, engine: str) -> str:
    """``sql`` preceded by the lenses it names."""
    ctes = [f"{name} AS ({_text(name, engine)})" for name in _needed(sql, engine)]
    body = sql.strip()
    shadowed = set(re.findall(r"(?:\bWITH(?:\s+RECURSIVE)?|,)\s+(\w+)\s+AS\s*\(\s*SELECT", body, re.I)) & set(lens_sql())
    if shadowed:
        raise ValueError(f"the query names a table like a lens: {sorted(shadowed)}")
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        ctes.append(re.sub(r"(?i)^with(\s+recursive)?\s+", "", body))
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes)
    return (f"WITH {',\n'.join(ctes)}\n{body}" if ctes else body)


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def lens(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A lens by name, or a SELECT over lenses, as a lazy DataFrame."""
    text = sql if re.search(r"\s", sql.strip()) else f"SELECT * FROM {sql}"
    used = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", with_lenses(text, "spark"))) & set(TABLES)
    for name in used:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(with_lenses(text, "spark"))
