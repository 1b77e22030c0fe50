"""Job-title columns: normalisation, match keys, seniority words, occupation codes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Seniority words dropped from a title, as regular-expression alternatives.
SENIORITY_WORDS = ["sr\\.?", "jr\\.?", "senior", "junior", "lead", "principal", "staff", "chief"]
MATCH_ONLY_WORDS = ["head", "associate", "assistant"]
TRAILING_GRADES = ["i", "ii", "iii", "iv", "v", "1", "2", "3"]

# Title words -> typical years of experience, first match wins.
GAP_TITLE_BANDS = [
    ("intern|trainee|junior|jr|graduate|fresher|entry", 0.0, 2.0),
    ("principal|staff|head|director|architect", 8.0, 15.0),
    ("lead|manager", 6.0, 12.0),
    ("senior|sr", 4.0, 8.0),
]
GAP_DEFAULT_BAND = (0.0, 5.0)
POSTING_TITLE_BANDS = [
    ("intern|internship|trainee", 0.0, 1.0),
    ("junior|jr|graduate|fresher|entry", 0.0, 2.0),
    ("principal|staff|head|director|architect", 8.0, 15.0),
    ("lead|manager", 6.0, 12.0),
    ("senior|sr", 4.0, 8.0),
]

# Two-digit occupation major groups -> (title, career cluster, local industry).
MAJOR_GROUPS = {
    "11": ("Management Occupations", "Leadership & Management", "Corporate / IT / Operations"),
    "13": ("Business and Financial Operations", "Finance & Banking", "Banking / Financial Services / Broking"),
    "15": ("Computer and Mathematical", "Information Technology", "IT-Software / Software Services"),
    "17": ("Architecture and Engineering", "Engineering & Design", "Engineering / Construction / Design"),
    "19": ("Life, Physical, and Social Science", "Sciences & Research", "Pharma / Biotech / Clinical Research"),
    "21": ("Community and Social Service", "Community Services", "NGO / Social Services"),
    "23": ("Legal Occupations", "Legal & Regulatory", "Legal / Law Firm"),
    "25": ("Educational Instruction and Library", "Education & Training", "Education / Teaching / Training"),
    "27": ("Arts, Design, Entertainment, Sports, and Media", "Creative & Media", "Media / Entertainment / Advertising"),
    "29": ("Healthcare Practitioners and Technical", "Healthcare & Medicine", "Medical / Healthcare / Hospital"),
    "31": ("Healthcare Support Occupations", "Healthcare Support", "Medical / Healthcare / Diagnostics"),
    "33": ("Protective Service Occupations", "Security & Protection", "Security / Law Enforcement"),
    "35": ("Food Preparation and Serving Related", "Hospitality & Food", "Hotels / Restaurants / Airlines / Travel"),
    "37": ("Building and Grounds Cleaning and Maintenance", "Facilities & Maintenance", "Facility Management"),
    "39": ("Personal Care and Service", "Personal Services & Wellness", "Wellness / Fitness / Beauty"),
    "41": ("Sales and Related Occupations", "Sales & Marketing", "Sales / Retail / Business Development"),
    "43": ("Office and Administrative Support", "Administration & Support", "BPO / Call Centre / ITES / Admin"),
    "45": ("Farming, Fishing, and Forestry", "Agriculture & Natural Resources", "Agriculture / Dairy"),
    "47": ("Construction and Extraction", "Construction & Infrastructure", "Construction / Engineering / Real Estate"),
    "49": ("Installation, Maintenance, and Repair", "Technical Maintenance", "Automobile / Auto Ancillary / Hardware"),
    "51": ("Production Occupations", "Manufacturing & Production", "Manufacturing / Industrial Products"),
    "53": ("Transportation and Material Moving", "Logistics & Supply Chain", "Courier / Transportation / Freight"),
    "55": ("Military Specific Occupations", "Defense & Government", "Defense / Government"),
}
DEFAULT_GROUP = ("General Occupations", "General", "General / Cross-Industry")

# Display names that title-casing would get wrong.
DISPLAY_NAMES = {
    "python": "Python", "ml": "Machine Learning", "machine_learning": "Machine Learning", "sql": "SQL",
    "deep_learning": "Deep Learning", "tensorflow": "TensorFlow", "pytorch": "PyTorch", "r": "R",
    "tableau": "Tableau", "nlp": "Natural Language Processing (NLP)", "computer_vision": "Computer Vision",
    "data_science": "Data Science", "scala": "Scala", "linux": "Linux", "kubernetes": "Kubernetes",
    "data_visualization": "Data Visualization", "gcp": "Google Cloud Platform (GCP)", "git": "Git",
    "hadoop": "Hadoop", "java": "Java", "aws": "AWS", "spark": "Apache Spark", "pyspark": "PySpark",
    "azure": "Microsoft Azure", "data_analysis": "Data Analysis", "mlops": "MLOps", "docker": "Docker",
    "scikit_learn": "Scikit-Learn", "pandas": "Pandas", "ai": "Artificial Intelligence (AI)",
    "neural_networks": "Neural Networks", "predictive_modeling": "Predictive Modeling",
    "data_mining": "Data Mining", "statistics": "Statistics", "big_data": "Big Data", "power_bi": "Power BI",
    "c": "C", "cpp": "C++", "nosql": "NoSQL", "mongodb": "MongoDB", "postgresql": "PostgreSQL",
    "mysql": "MySQL", "rest_api": "REST APIs", "ci_cd": "CI/CD", "cloud_computing": "Cloud Computing",
    "kafka": "Apache Kafka", "etl": "ETL Pipelines", "sas": "SAS", "excel": "Advanced Excel",
    "autocad": "AutoCAD", "tally": "Tally ERP", "gst": "GST Compliance", "crm": "CRM Systems",
}


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def _clean_title(title: Column, words: list[str], strict: bool) -> Column:
    edge = r"\b" if strict else ""
    t = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    t = F.regexp_replace(t, r"\s*[\(\[].*?[\)\]]", "")
    t = F.regexp_replace(t, rf"\s*{edge}({'|'.join(words)}){edge}\s*", " ")
    t = F.regexp_replace(t, rf"\s*{edge}({'|'.join(TRAILING_GRADES)})\s*$", "")
    return squeeze(F.regexp_replace(t, r"[^a-z0-9\s]", ""))


def normalize_title(title: Column, *, strict: bool = False) -> Column:
    """Lower-case title without qualifiers, seniority words and trailing grades.

    ``strict`` asks for word boundaries; the default also cuts inside words, as published data expects.
    """
    return _clean_title(title, SENIORITY_WORDS, strict)


def title_match_key(title: Column, *, strict: bool = False) -> Column:
    """``normalize_title`` that also drops head / associate / assistant: the key titles are joined on."""
    return _clean_title(title, SENIORITY_WORDS + MATCH_ONLY_WORDS, strict)


def first_two_words(key: Column) -> Column:
    words = F.split(key, " ")
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))


def canonical_code(code: Column) -> Column:
    """``29-1141`` -> ``29-1141.00``."""
    c = F.trim(code)
    return F.when((F.length(c) == 7) & ~c.contains("."), F.concat(c, F.lit(".00"))).otherwise(c)


def major_group(code: Column) -> Column:
    """Struct (soc_major_group, major_group_title, career_cluster, local_industry) of an occupation code."""
    prefix = F.substring(code, 1, 2)
    parts = ["major_group_title", "career_cluster", "local_industry"]
    fields = [
        F.coalesce(F.try_element_at(literal_map({k: v[i] for k, v in MAJOR_GROUPS.items()}), prefix),
                   F.lit(DEFAULT_GROUP[i])).alias(name)
        for i, name in enumerate(parts)
    ]
    return F.struct(prefix.alias("soc_major_group"), *fields)


def title_words(title: Column, alternatives: str) -> Column:
    return F.lower(title).rlike(rf"\b({alternatives})\b")


def title_band(title: Column, bands: list[tuple[str, float, float]] = POSTING_TITLE_BANDS,
               default: tuple[float, float] | None = None) -> Column:
    """Struct (min, max) of years suggested by seniority words in a title; first band wins."""
    def band(lo: float, hi: float) -> Column:
        return F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max"))

    out = F.lit(None) if default is None else band(*default)
    return reduce(lambda acc, b: F.when(title_words(title, b[0]), band(b[1], b[2])).otherwise(acc),
                  reversed(bands), out)


def next_rung(title: Column) -> Column:
    """none -> Senior -> Lead -> Principal -> NULL."""
    word = F.lower(F.regexp_extract(title, r"(?i)^\s*(senior|sr\.?|lead|principal)\s+", 1))
    word = F.regexp_replace(word, r"\.$", "")
    base = F.when(word == "", F.trim(title)).otherwise(
        F.regexp_replace(title, r"(?i)^\s*(?:senior|sr\.?|lead|principal)\s+", ""))
    rung = (F.when(word == "", F.lit("Senior")).when(word.isin("senior", "sr"), F.lit("Lead"))
            .when(word == "lead", F.lit("Principal")))
    return F.concat(rung, F.lit(" "), base)


def display_name(slug: Column) -> Column:
    """Readable name of a skill slug: a fixed name or the title-cased slug."""
    return F.coalesce(F.try_element_at(literal_map(DISPLAY_NAMES), F.lower(slug)),
                      F.initcap(F.replace(slug, F.lit("_"), F.lit(" "))))


def readable(slug: Column) -> Column:
    """Short ids read as acronyms, longer ones with spaces."""
    return F.when(F.length(slug) <= 3, F.upper(slug)).otherwise(F.replace(slug, F.lit("_"), F.lit(" ")))


def item_slug(prefix: str, name: Column) -> Column:
    """Requirement id of a technology or tool."""
    return F.concat(F.lit(prefix + "_"), F.lower(F.translate(name, " /-()", "___")))


def word_slug(name: Column) -> Column:
    """Lower-case words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
