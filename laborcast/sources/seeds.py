"""Small reference tables that ship with the library. All are bounded constants and safe to broadcast."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.titles import MAJOR_GROUPS

# Fixed values: (category, level, local equivalent, rank).
EDUCATION_LEVELS = [
    (1, "Less than a High School Diploma", "Below 10th Standard", 1),
    (2, "High School Diploma (or GED)", "10th / 12th Pass (HSC)", 2),
    (3, "Post-Secondary Certificate", "ITI / Vocational Certificate", 3),
    (4, "Some College Courses", "Polytechnic / Vocational Diploma", 4),
    (5, "Associate's Degree", "Diploma / Associate Degree", 5),
    (6, "Bachelor's Degree", "Bachelor's Degree (B.Tech / B.Sc / B.Com / BA / BBA / MBBS)", 6),
    (7, "Post-Baccalaureate Certificate", "Post Graduate Diploma (PGD)", 7),
    (8, "Master's Degree", "Master's Degree (M.Tech / MBA / M.Sc / MA / MS)", 8),
    (9, "Post-Master's Certificate", "Advanced PG Diploma / M.Phil", 9),
    (10, "First Professional Degree", "Professional Degree (CA / CS / LLB / MBBS)", 10),
    (11, "Doctoral Degree", "Doctorate / PhD", 11),
    (12, "Post-Doctoral Training", "Post-Doctoral Fellowship", 12),
]
# Colloquial titles -> (code, confidence).
TITLE_ALIASES = [
    ("staff nurse", "29-1141.00", 1.0), ("nurse", "29-1141.00", 0.95), ("nursing officer", "29-1141.00", 1.0),
    ("sister in charge", "29-1141.00", 0.95), ("icu nurse", "29-1141.00", 0.95), ("gnm nurse", "29-1141.00", 0.90),
    ("pharmacist", "29-1051.00", 1.0), ("chemist", "29-1051.00", 0.90), ("druggist", "29-1051.00", 0.90),
    ("hospital pharmacist", "29-1051.00", 1.0), ("medical assistant", "31-9092.00", 1.0),
    ("lab technician", "29-2012.00", 0.95), ("phlebotomist", "31-9097.00", 1.0), ("ca", "13-2011.00", 1.0),
    ("chartered accountant", "13-2011.00", 1.0), ("accountant", "13-2011.00", 0.95),
    ("senior accountant", "13-2011.00", 0.95), ("chief accountant", "13-2011.00", 0.95),
    ("tax consultant", "13-2081.00", 0.95), ("audit executive", "13-2011.00", 0.90),
    ("accounts executive", "13-2011.00", 0.90), ("tally accountant", "13-2011.00", 0.90),
    ("gst accountant", "13-2011.00", 0.90), ("loan officer", "13-2072.00", 1.0),
    ("credit manager", "13-2072.00", 0.95), ("secondary school teacher", "25-2031.00", 1.0),
    ("pgt teacher", "25-2031.00", 1.0), ("tgt teacher", "25-2022.00", 1.0), ("school teacher", "25-2031.00", 0.90),
    ("lecturer", "25-1099.00", 0.90), ("medical representative", "41-4012.00", 1.0), ("mr", "41-4012.00", 0.90),
    ("pharma sales", "41-4012.00", 0.95), ("relationship manager", "41-4012.00", 0.90), ("bde", "41-4012.00", 0.90),
    ("sales representative", "41-4012.00", 0.95), ("field sales executive", "41-4012.00", 0.90),
    ("telecaller", "43-4051.00", 1.0), ("bpo executive", "43-4051.00", 0.95),
    ("customer support executive", "43-4051.00", 0.95), ("site engineer", "17-2051.00", 1.0),
    ("civil site engineer", "17-2051.00", 1.0), ("civil engineer", "17-2051.00", 1.0),
    ("structural engineer", "17-2051.00", 1.0), ("mechanical engineer", "17-2141.00", 1.0),
    ("production engineer", "17-2141.00", 0.90), ("electrician", "47-2111.00", 1.0),
    ("iti electrician", "47-2111.00", 1.0), ("wireman", "47-2111.00", 0.95), ("chef", "35-1011.00", 1.0),
    ("head cook", "35-1011.00", 1.0), ("executive chef", "35-1011.00", 1.0), ("truck driver", "53-3032.00", 1.0),
    ("heavy vehicle driver", "53-3032.00", 1.0), ("graphic designer", "27-1024.00", 1.0),
    ("ui designer", "27-1024.00", 0.95), ("visual designer", "27-1024.00", 0.95),
    ("data scientist", "15-2051.00", 1.0), ("data engineer", "15-1252.00", 1.0), ("data analyst", "15-2051.01", 1.0),
    ("machine learning engineer", "15-2051.00", 1.0), ("backend developer", "15-1252.00", 1.0),
    ("full stack developer", "15-1252.00", 1.0), ("devops engineer", "15-1244.00", 1.0),
]


def title_aliases(spark: SparkSession) -> DataFrame:
    rows = [(t, c, conf, i) for i, (t, c, conf) in enumerate(TITLE_ALIASES)]
    return spark.createDataFrame(rows, "raw_title string, soc_code string, confidence double, load_id int")


def education_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDUCATION_LEVELS, "category int, level string, local_level string, hierarchy_level int")


def major_groups(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in MAJOR_GROUPS.items()]
    return spark.createDataFrame(rows, "soc_major_group string, major_group_title string, career_cluster string, local_industry string")

# A small starter taxonomy: (id, display, category, maps_to, prerequisites, difficulty tier, is a broad field, aliases).
SKILLS = [
    ("programming", "Programming", "field", None, [], 1, True, ["programming", "coding"]),
    ("data", "Data", "field", None, [], 1, True, ["data work"]),
    ("databases", "Databases", "field", "data", [], 1, True, ["databases"]),
    ("ai", "Artificial Intelligence", "field", "data", [], 2, True, ["ai", "artificial intelligence"]),
    ("cloud", "Cloud", "field", None, [], 1, True, ["cloud", "cloud computing"]),
    ("healthcare", "Healthcare", "field", None, [], 1, True, ["healthcare"]),
    ("python", "Python", "language", "programming", [], 1, False, ["python", "python3"]),
    ("java", "Java", "language", "programming", [], 2, False, ["java"]),
    ("javascript", "JavaScript", "language", "programming", [], 1, False, ["javascript", "js"]),
    ("nodejs", "Node.js", "framework", "javascript", ["javascript"], 2, False, ["node.js", "nodejs"]),
    ("react", "React", "framework", "javascript", ["javascript"], 2, False, ["react", "react.js"]),
    ("react_native", "React Native", "framework", "react", ["react"], 2, False, ["react native"]),
    ("cpp", "C++", "language", "programming", ["c"], 3, False, ["c++"]),
    ("c", "C", "language", "programming", [], 2, False, ["c"]),
    ("r", "R", "language", "programming", [], 2, False, ["r"]),
    ("go", "Go", "language", "programming", [], 2, False, ["go", "golang"]),
    ("sql", "SQL", "database", "databases", [], 1, False, ["sql"]),
    ("postgresql", "PostgreSQL", "database", "sql", ["sql"], 2, False, ["postgresql", "postgres"]),
    ("mysql", "MySQL", "database", "sql", ["sql"], 2, False, ["mysql"]),
    ("pandas", "Pandas", "library", "python", ["python"], 1, False, ["pandas"]),
    ("statistics", "Statistics", "method", "data", [], 2, False, ["statistics"]),
    ("machine_learning", "Machine Learning", "method", "ai", ["python", "statistics"], 3, False, ["machine learning", "ml"]),
    ("deep_learning", "Deep Learning", "method", "machine_learning", ["machine_learning"], 3, False, ["deep learning"]),
    ("generative_ai", "Generative AI", "method", "ai", ["deep_learning"], 3, False, ["generative ai", "genai"]),
    ("aws", "AWS", "platform", "cloud", [], 2, False, ["aws", "amazon web services"]),
    ("azure", "Microsoft Azure", "platform", "cloud", [], 2, False, ["azure", "microsoft azure"]),
    ("gcp", "Google Cloud", "platform", "cloud", [], 2, False, ["google cloud", "gcp"]),
    ("docker", "Docker", "tool", "cloud", ["linux"], 2, False, ["docker"]),
    ("kubernetes", "Kubernetes", "tool", "cloud", ["docker"], 3, False, ["kubernetes", "k8s"]),
    ("linux", "Linux", "tool", None, [], 1, False, ["linux"]),
    ("git", "Git", "tool", None, [], 1, False, ["git"]),
    ("spark", "Apache Spark", "tool", "data", ["python", "sql"], 3, False, ["spark", "apache spark"]),
    ("hadoop", "Hadoop", "tool", "data", ["java", "linux"], 3, False, ["hadoop"]),
    ("tableau", "Tableau", "tool", "data", ["sql"], 1, False, ["tableau"]),
    ("power_bi", "Power BI", "tool", "data", [], 1, False, ["power bi"]),
    ("excel", "Excel", "tool", "data", [], 1, False, ["excel"]),
    ("nursing", "Nursing", "care", "healthcare", [], 2, False, ["nursing"]),
    ("patient_care", "Patient Care", "care", "nursing", [], 1, False, ["patient care"]),
    ("autocad", "AutoCAD", "tool", None, [], 2, False, ["autocad"]),
    ("wiring", "Wiring", "trade", None, [], 2, False, ["wiring"]),
]
# Aliases too ambiguous to accept anywhere: alias -> rule.
AMBIGUOUS_ALIASES = {"c": "list", "r": "list", "go": "case", "spark": "case", "excel": "case"}
# Names that look like skills and are broad labels.
NON_SKILLS = [("communication", "a general trait"), ("management", "a broad label"), ("level_2", "a level, not a skill")]

SKILL_SCHEMA = ("id string, display string, category string, maps_to string, prerequisites array<string>, difficulty_tier int, "
                "is_category boolean, load_id int")


def taxonomy(spark: SparkSession, extra_aliases: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(skills, aliases) of the starter taxonomy, with further (id, alias) pairs if given."""
    skills = [(*s[:7], i) for i, s in enumerate(SKILLS)]
    pairs = [(s[0], a) for s in SKILLS for a in s[7]] + list(extra_aliases)
    rows = [(i, a, AMBIGUOUS_ALIASES.get(a)) for i, a in pairs]
    return spark.createDataFrame(skills, SKILL_SCHEMA), spark.createDataFrame(rows, "id string, alias string, rule string")


def non_skills(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NON_SKILLS, "id string, reason string")
