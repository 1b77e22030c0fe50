"""Columns read out of posting text: mode, employment, quality, duplicate key, fingerprint."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values
SHORT_DESCRIPTION = 200
EMPLOYMENT_CODES = {"FULLTIME": "full_time", "PARTTIME": "part_time", "CONTRACTOR": "contract", "INTERN": "internship",
                    "TEMPORARY": "temporary"}
CONTRACT_TIMES = {"full_time": "full_time", "part_time": "part_time"}
CONTRACT_TYPES = {"contract": "contract", "permanent": "full_time"}
COMPANY_NOISE = ["pvt", "private", "ltd", "limited", "inc", "llp", "llc", "corp", "corporation", "co", "india",
                 "technologies", "technology", "solutions", "services"]
_BLANK = r" \t\n\x0B\f\r"
PROFILE_HOSTS = ["linkedin", "github", "gitlab", "kaggle", "leetcode", "medium"]
# An address is looked for once per run of characters, as any later start in the run fails or lies inside the match; the
# look-aheads spare the other tests where no link or profile host can begin.
CONTACT_PATTERN = (rf"(?<![^{_BLANK}])[^{_BLANK}][^{_BLANK}@]*+@\S+"
                   rf"|(?=[hwlgkmHWLGKM])(?i:(?:https?://|www\.)\S+|\b(?:{'|'.join(PROFILE_HOSTS)})[.\s]com\S*)")


def _lookup(col: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: F.when(col == kv[0], F.lit(kv[1])).otherwise(acc), pairs.items(), F.lit(None).cast("string"))


def work_mode(text: Column, is_remote: Column | None = None) -> Column:
    """remote / hybrid / onsite / unknown from the provider's flag, then the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    mode = (F.when(low.contains("hybrid"), "hybrid")
            .when(low.rlike(r"\b(remote|work from home|wfh)\b"), "remote")
            .when(low.rlike(r"\b(on-?site|in-?office|work from office)\b"), "onsite").otherwise("unknown"))
    return mode if is_remote is None else F.when(F.coalesce(is_remote, F.lit(False)), "remote").otherwise(mode)


def description_quality(text: Column) -> Column:
    """missing / short / ok by trimmed length."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(size == 0, "missing").when(size < SHORT_DESCRIPTION, "short").otherwise("ok")


def internship_title(title: Column) -> Column:
    return F.when(F.lower(title).rlike(r"\bintern(ship)?\b"), F.lit("internship"))


def employment_type(title: Column, contract_time: Column, contract_type: Column) -> Column:
    """Employment type from the title, the contract time, then the contract type."""
    return F.coalesce(internship_title(title), _lookup(contract_time, CONTRACT_TIMES),
                      _lookup(contract_type, CONTRACT_TYPES), F.lit("unknown"))


def employment_from_codes(title: Column, codes: Column) -> Column:
    """Employment type from the title, else the first known code of a list."""
    known = F.filter(F.transform(codes, lambda c: _lookup(F.upper(c), EMPLOYMENT_CODES)), lambda c: c.isNotNull())
    return F.coalesce(internship_title(title), F.get(known, F.lit(0)), F.lit("unknown"))


def salary_currency(code: Column, text: Column) -> Column:
    """Currency from an explicit code, else from symbols in the salary text, else INR."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.coalesce(code, F.lit("")) != "", F.upper(code))
            .when(t.contains("$") | F.upper(t).contains("USD"), "USD")
            .when(t.contains("€") | t.contains("£"), "OTHER").otherwise("INR"))


def plain_name(name: Column) -> Column:
    """Lower-case words of a name without legal and generic company suffixes."""
    low = F.lower(F.coalesce(name, F.lit("")))
    bare = F.regexp_replace(low, rf"\b({'|'.join(COMPANY_NOISE)})\b\.?", " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def duplicate_key(title: Column, company: Column, city: Column) -> Column:
    """sha1 of normalised title | company | city: the same job seen at two sources."""
    return F.sha1(F.concat_ws("|", plain_name(title), plain_name(company), plain_name(city)).cast("binary"))


def strip_contacts(text: Column) -> Column:
    """Text without e-mail addresses, links and profile hosts."""
    low = F.lower(text)
    # Every match holds one of these; most texts hold none, and the pattern is far dearer than the search for them.
    may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in ["@", "://", "www.", *PROFILE_HOSTS]])
    return F.when(may, F.regexp_replace(text, CONTACT_PATTERN, " ")).otherwise(F.coalesce(text, F.lit("")))


def fingerprint(text: Column) -> Column:
    """sha1 of the text: kept in place of the text itself."""
    return F.sha1(text.cast("binary"))
