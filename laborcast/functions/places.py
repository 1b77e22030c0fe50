"""City and country columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .titles import literal_map

# Lower-case spellings -> city.
CITY_ALIASES = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "blr": "Bengaluru",
    "gurgaon": "Gurugram", "gurugram": "Gurugram",
    "mumbai": "Mumbai", "bombay": "Mumbai", "navi mumbai": "Mumbai", "thane": "Mumbai",
    "delhi": "Delhi", "new delhi": "Delhi",
    "noida": "Noida", "greater noida": "Noida",
    "delhi ncr": "Delhi NCR", "delhi-ncr": "Delhi NCR", "ncr": "Delhi NCR", "delhi/ncr": "Delhi NCR",
    "hyderabad": "Hyderabad", "secunderabad": "Hyderabad", "hyd": "Hyderabad",
    "chennai": "Chennai", "madras": "Chennai", "kolkata": "Kolkata", "calcutta": "Kolkata",
    "pune": "Pune", "poona": "Pune", "kochi": "Kochi", "cochin": "Kochi", "ahmedabad": "Ahmedabad",
    "jaipur": "Jaipur", "chandigarh": "Chandigarh", "indore": "Indore", "coimbatore": "Coimbatore",
    "trivandrum": "Thiruvananthapuram", "thiruvananthapuram": "Thiruvananthapuram",
    "remote": "Remote", "work from home": "Remote", "anywhere in india": "Remote",
}
# The spellings candidate profiles use.
PROFILE_CITY_ALIASES = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "blr": "Bengaluru",
    "gurgaon": "Gurugram", "gurugram": "Gurugram", "bombay": "Mumbai", "mumbai": "Mumbai",
    "delhi": "Delhi", "new delhi": "Delhi", "delhi ncr": "Delhi NCR", "ncr": "Delhi NCR",
    "noida": "Noida", "hyderabad": "Hyderabad", "hyd": "Hyderabad", "secunderabad": "Hyderabad",
    "chennai": "Chennai", "madras": "Chennai", "kolkata": "Kolkata", "calcutta": "Kolkata",
    "pune": "Pune", "poona": "Pune", "kochi": "Kochi", "cochin": "Kochi", "mysore": "Mysuru",
    "mysuru": "Mysuru", "trivandrum": "Thiruvananthapuram", "vizag": "Visakhapatnam",
}
# Regions and their cities.
REGIONS = {"Delhi NCR": ["Delhi", "Noida", "Gurugram"]}

# Fixed values: (substrings, city, state, tier, metro group), first rule wins.
CITY_RULES = [
    (["bengaluru", "bangalore"], "Bengaluru", "Karnataka", 1, "Bengaluru"),
    (["hyderabad", "secunderabad"], "Hyderabad", "Telangana", 1, "Hyderabad"),
    (["pune"], "Pune", "Maharashtra", 1, "Pune"),
    (["mumbai", "navi mumbai", "thane"], "Mumbai", "Maharashtra", 1, "Mumbai MMR"),
    (["gurgaon", "gurugram"], "Gurugram", "Haryana", 1, "Delhi NCR"),
    (["noida", "greater noida"], "Noida", "Uttar Pradesh", 1, "Delhi NCR"),
    (["faridabad"], "Faridabad", "Haryana", 1, "Delhi NCR"),
    (["ghaziabad"], "Ghaziabad", "Uttar Pradesh", 1, "Delhi NCR"),
    (["delhi"], "Delhi", "Delhi", 1, "Delhi NCR"),
    (["chennai"], "Chennai", "Tamil Nadu", 1, "Chennai"),
    (["kolkata"], "Kolkata", "West Bengal", 1, "Kolkata"),
    (["remote"], "Remote", "Remote", 0, "Remote"),
    (["ahmedabad", "gandhinagar"], "Ahmedabad", "Gujarat", 2, "Ahmedabad"),
    (["chandigarh", "mohali", "panchkula"], "Chandigarh", "Punjab/Haryana", 2, "Chandigarh Tri-city"),
    (["jaipur"], "Jaipur", "Rajasthan", 2, "Jaipur"),
    (["indore"], "Indore", "Madhya Pradesh", 2, "Indore"),
    (["kochi", "ernakulam"], "Kochi", "Kerala", 2, "Kochi"),
    (["coimbatore"], "Coimbatore", "Tamil Nadu", 2, "Coimbatore"),
    (["lucknow"], "Lucknow", "Uttar Pradesh", 2, "Lucknow"),
    (["bhopal"], "Bhopal", "Madhya Pradesh", 2, "Bhopal"),
    (["bhubaneshwar", "bhubaneswar"], "Bhubaneswar", "Odisha", 2, "Bhubaneswar"),
    (["trivandrum", "thiruvananthapuram"], "Trivandrum", "Kerala", 2, "Trivandrum"),
    (["vadodara"], "Vadodara", "Gujarat", 2, "Vadodara"),
    (["surat"], "Surat", "Gujarat", 2, "Surat"),
    (["mysore", "mysuru"], "Mysore", "Karnataka", 3, "Mysore"),
    (["visakhapatnam", "vizag"], "Visakhapatnam", "Andhra Pradesh", 2, "Visakhapatnam"),
    (["nagpur"], "Nagpur", "Maharashtra", 2, "Nagpur"),
    (["patna"], "Patna", "Bihar", 3, "Patna"),
]
# Country markers in order.
COUNTRY_RULES = [
    ("India", ["india", "mumbai", "bangalore", "bengaluru", "delhi", "hyderabad", "pune", "chennai", "kolkata",
               "noida", "gurgaon", "gurugram"]),
    ("United States", ["united states", ", us", ", ca", ", ny", ", tx", ", wa"]),
    ("United Kingdom", ["united kingdom", ", uk", "london"]),
    ("Germany", ["germany", "berlin", "munich"]),
    ("Canada", ["canada", "toronto", "vancouver"]),
]


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def guess_country(location: Column) -> Column:
    """Country of a location text by ordered markers; Unknown when empty, Other when none fits."""
    text = F.lower(location)
    hits = [F.when(contains_any(text, marks), F.lit(name)) for name, marks in COUNTRY_RULES]
    return F.when(F.coalesce(location, F.lit("")) == "", F.lit("Unknown")).otherwise(F.coalesce(*hits, F.lit("Other")))


def city_part(location: Column, default: str = "India") -> Column:
    """Text before the first comma; ``default`` where no location is given."""
    return F.when(F.coalesce(F.trim(location), F.lit("")) == "", F.lit(default)) \
        .otherwise(F.trim(F.split_part(location, F.lit(","), F.lit(1))))


def _known(key: Column, aliases: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(aliases), key)


def normalize_city(name: Column) -> Column:
    """Known city of the whole text, else of the part before the comma, else that part title-cased."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    first = F.trim(F.split_part(key, F.lit(","), F.lit(1)))
    return F.when(F.trim(name) != "", F.coalesce(_known(key, CITY_ALIASES), _known(first, CITY_ALIASES), F.initcap(first)))


def profile_city(name: Column) -> Column:
    """The candidate-profile variant: only the part before the comma is looked up."""
    first = F.trim(F.split_part(name, F.lit(","), F.lit(1)))
    key = F.regexp_replace(F.lower(first), r"\s+", " ")
    return F.when(F.trim(name) != "", F.coalesce(_known(key, PROFILE_CITY_ALIASES), F.initcap(first)))


def expand_city(name: Column) -> Column:
    """Array of cities a place name stands for: a region's members or the city itself."""
    city = normalize_city(name)
    out = F.array(city)
    for region, members in REGIONS.items():
        out = F.when(city == region, F.array(*[F.lit(m) for m in members])).otherwise(out)
    return F.when(city.isNotNull(), out).otherwise(F.array().cast("array<string>"))


def city_from_path(parts: Column) -> Column:
    """Most specific known city of a path such as [India, Karnataka, Bangalore], else its last part."""
    keys = list(CITY_ALIASES)
    known = F.filter(F.reverse(parts), lambda p: F.lower(F.trim(p)).isin(keys))
    return F.coalesce(normalize_city(F.get(known, F.lit(0))), normalize_city(F.try_element_at(parts, F.lit(-1))))


def canonical_city(city: Column) -> Column:
    """Struct (city_canonical, state, tier, metro_group) by ordered substring rules."""
    c = F.trim(city)
    low = F.lower(c)

    def place(name: Column, state: str, tier: int, metro: Column) -> Column:
        return F.struct(name.alias("city_canonical"), F.lit(state).alias("state"), F.lit(tier).alias("tier"),
                        metro.alias("metro_group"))

    tidy = F.initcap(F.regexp_replace(c, r"^[-\s]+", ""))
    return reduce(lambda acc, r: F.when(contains_any(low, r[0]), place(F.lit(r[1]), r[2], r[3], F.lit(r[4]))).otherwise(acc),
                  reversed(CITY_RULES), place(tidy, "Other", 3, tidy))


def region_members(city: Column) -> Column:
    """Cities that share a region with ``city``; an empty array outside every region."""
    out = F.array().cast("array<string>")
    for members in REGIONS.values():
        out = F.when(city.isin(members), F.array(*[F.lit(m) for m in members])).otherwise(out)
    return out
