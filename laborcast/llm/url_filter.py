"""URL verdicts: host and path rules first, then a list of canonical URLs.

The list becomes a Bloom filter in blocks: a URL's hash names one block of eight words, and one bit of each word is its
own. Only URLs whose eight bits are all set go on to an exact join with the list, which removes the false hits; all
others are settled without one. Everything is DataFrame functions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, without

#: URLs to a block; a block has eight words of 64 bits, so a false hit is about one in ten thousand.
PER_BLOCK = 32
WORDS = 8
#: Blocks that may be broadcast: 65,536 blocks of about 100 bytes. A larger filter is joined by a shuffle on the block.
BROADCAST_BLOCKS = 1 << 16
#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """The host (A-Z in lower case) and the path of a URL; both are empty for null and for text without ``://``."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling for the addresses of a page: no scheme, query, fragment, ``www.`` or ``m.``, page suffix or last slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/+|/index\.html?|\.html?)$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of two equally long ones the first listed.

    A rule fits its host and all hosts below it where the path starts with the rule's. ``rules`` is a short list that is
    part of the plan.
    """
    rule = verdict = None
    for name, start, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(name + start)) if rule is None else rule.when(fits, F.lit(name + start))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """One bit of each word, from a second hash of the URL."""
    second = F.xxhash64(F.lit("bits"), url)
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of the distinct URLs in ``listed`` (column ``canonical``), one row for each block in use."""
    words = [b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("canonical")))]
    return (listed.select(_block(F.col("canonical"), blocks).alias("block"), *words)
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url") -> DataFrame:
    """``pages`` with host, path, canonical, rule, listed and verdict; columns of these names are replaced.

    ``verdict`` is the rule's if one fits, else ``block`` for a listed URL and ``allow`` for any other. URLs are compared
    by their canonical form; null, empty and malformed ones are on no list. Repeated rows and repeated list entries are
    fine. An empty list blocks nothing, no pages give no rows.
    """
    names = ["host", "path", "canonical", "rule", "listed", "verdict"]
    if url in names:
        raise ValueError(f"the URL column can't be called {url}")
    host, path = host_and_path(listed_url)
    entries = cut(listed.select(canonical(host, path).alias("canonical")).where("canonical <> ''").distinct())
    blocks = max(1, -(-entries.count() // PER_BLOCK))
    bloom = bloom_blocks(entries, blocks)
    host, path = host_and_path(url)
    plain = without(pages, *names).withColumn("host", host).withColumn("path", path).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    words = [f"__word{i}" for i in range(WORDS)]  # names that no page column has
    bloom = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(w) for i, w in enumerate(words)])
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    probed = plain.withColumn("__block", _block(F.col("canonical"), blocks)).join(bloom, "__block", "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(words[i]).bitwiseAND(bit) == bit)
    probed = probed.withColumn("__possible", F.coalesce(hit, F.lit(False))).drop("__block", *words)
    # Hits alone meet the list; the rest would be null keys of an outer join and all land in one task.
    confirmed = probed.where("__possible").join(entries.withColumn("listed", F.lit(True)), "canonical", "left")
    columns = [F.col(f"`{c}`") for c in plain.columns]
    both = (confirmed.select(*columns, F.coalesce("listed", F.lit(False)).alias("listed"))
            .unionAll(probed.where("NOT __possible").select(*columns, F.lit(False).alias("listed"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(*columns, rule.alias("rule"), "listed", F.coalesce(verdict, method).alias("verdict"))
