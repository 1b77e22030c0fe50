"""Secret scans: named patterns, and strings whose windows have a high Shannon entropy for their class of characters.

All of it is DataFrame functions. Positions come from the pieces between matches, so each pattern reads a text once more
only where it has a match. Entropy is computed by a window that slides over a candidate string: two counts change at each
step, and so does the sum of ``c log2 c``, kept as a whole number so that no error builds up.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import without

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern): the second and third match only where the whole run is long enough, which is the same as dropping short runs.
PATTERNS = [("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}")]
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "entropy"]

#: Characters in a window of the entropy scan; a candidate has as many at least.
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: (class of characters, pattern of the whole candidate, bits from which a window counts), the first that fits.
CLASSES = [("hex", "^[0-9a-fA-F]+$", 2.9), ("alphanumeric", "^([0-9a-z_-]+|[0-9A-Z_-]+)$", 3.6), ("base64", "", 3.8)]
#: Candidates that are never secrets: without digits or without letters, UUIDs, and stated examples or fillers.
ALLOWED = [
    "^[^0-9]*$", "^[^A-Za-z]*$", "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    "(?i)example|sample|placeholder|changeme|dummy|your_|xxxx|0123456789|abcdefgh",
]
#: Nor are paths and names of plain words: all parts between JOINTS are letters with few digits after them.
JOINTS, PLAIN = "[_=+/-]+", "^[A-Za-z]*[0-9]{0,3}$"
_SCALE = 1 << 20
_CHUNK = 256
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Running sums of an array, chunk by chunk, so that a long array is not copied at every step."""
    zero = F.lit(0).cast("bigint")

    def inside(start: Column, chunk: Column) -> Column:
        first = F.struct(start.alias("t"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(chunk, first, lambda a, v: F.struct((a["t"] + v).alias("t"), F.array_append(a["o"], a["t"] + v).alias("o")), lambda a: a["o"])

    chunks = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.struct(zero.alias("t"), F.array().cast("array<array<bigint>>").alias("o"))

    def step(acc: Column, b: Column) -> Column:
        return _let(F.slice(lengths, b * _CHUNK + 1, F.lit(_CHUNK)), lambda chunk: F.struct(
            (acc["t"] + F.aggregate(chunk, zero, lambda x, y: x + y)).alias("t"), F.array_append(acc["o"], inside(acc["t"], chunk)).alias("o")))

    return F.flatten(F.aggregate(chunks, first, step, lambda a: a["o"]))


def with_matches(docs: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """``docs`` with ``name``: the leftmost matches that don't overlap, as (m, start, end) in code points, end exclusive."""
    docs = docs.withColumn(name, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    docs = docs.withColumn("__ends", F.when(F.size(name) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    lengths = F.zip_with(F.slice("__ends", 1, F.size(name)), F.col(name), lambda before, m: (F.length(before) + F.length(m)).cast("bigint"))
    docs = docs.withColumn("__ends", lengths).withColumn("__ends", _running(F.col("__ends")))
    return docs.withColumn(name, F.zip_with(F.col(name), F.col("__ends"), lambda m, end: F.struct(m.alias("m"), (end - F.length(m)).alias("start"), end.alias("end")))).drop("__ends")


def _weight(count: int) -> int:
    """``c log2 c`` as a whole number of 2**-20."""
    return round(count * math.log2(count) * _SCALE) if count else 0


def hot_range(codes: Column, bits: Column) -> Column:
    """(lo, hi): from the first to the last window of ``codes`` whose entropy reaches ``bits``; null if none does.

    With counts c the entropy of a window is log2(W) - sum(c log2 c) / W. A step takes the leaving character off its
    count, adds the entering one to its own, and changes the sum by four terms of a table.
    """
    table = F.array(*[F.lit(_weight(c)).cast("bigint") for c in range(WINDOW + 1)])
    limit = F.floor((F.lit(math.log2(WINDOW)) - bits) * (WINDOW * _SCALE))
    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).cast("bigint").alias("sum"), none.alias("lo"), none.alias("hi"))

    def step(acc: Column, i: Column) -> Column:
        leaving = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
        entering = F.get(codes, i)
        one = lambda condition: F.when(condition, F.lit(1)).otherwise(F.lit(0))
        left = F.get(acc["counts"], leaving)
        less = F.when(leaving >= 0, F.get(table, left - 1) - F.get(table, left)).otherwise(F.lit(0).cast("bigint"))
        have = F.get(acc["counts"], entering) - one(entering == leaving)
        total = acc["sum"] + less + F.get(table, have + 1) - F.get(table, have)
        counts = F.transform(acc["counts"], lambda c, k: c + one(k == entering) - one(k == leaving))
        return _let(total, lambda s: F.struct(
            counts.alias("counts"), s.alias("sum"),
            F.when((i >= WINDOW - 1) & (s <= limit), F.coalesce(acc["lo"], i - (WINDOW - 1))).otherwise(acc["lo"]).alias("lo"),
            F.when((i >= WINDOW - 1) & (s <= limit), i + 1).otherwise(acc["hi"]).alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: F.when(a["lo"].isNotNull(), F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))


def _entropy_span(candidate: Column) -> Column:
    m = candidate["m"]
    bits = F.lit(CLASSES[-1][2])
    for _, pattern, least in reversed(CLASSES[:-1]):
        bits = F.when(m.rlike(pattern), F.lit(least)).otherwise(bits)
    codes = F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return _let(codes, lambda cs: _let(hot_range(cs, bits), lambda hot: F.when(hot.isNotNull(), F.struct(
        F.lit("entropy").alias("kind"), (candidate["start"] + hot["lo"]).alias("start"), (candidate["start"] + hot["hi"]).alias("end")))))


def in_order(spans: Column) -> Column:
    """Spans by start, then by kind in the order of KINDS, then by end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (kind, start, end) in code points, in order; columns of these
    names are replaced.

    ``base_spans`` are those of PATTERNS; ``spans`` adds those of the entropy scan that no base span holds. A null or
    empty text has none. Texts are scanned whole, every row is kept, no rows give no rows. There is no shuffle.
    """
    found = without(docs, "base_spans", "spans").withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    columns = [F.col(f"`{c}`") for c in found.columns if c != "__text"]
    for kind, pattern in PATTERNS:
        found = with_matches(found, "__text", pattern, f"__{kind}")
    found = with_matches(found, "__text", CANDIDATE, "__candidates")
    value = lambda m: F.length(F.regexp_extract(m["m"], ASSIGN, 2)) >= LEAST_VALUE
    found = found.withColumn("__assign", F.filter("__assign", value))
    named = lambda kind: F.transform(f"__{kind}", lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    plain = [named(kind) for kind, _ in PATTERNS]
    found = found.withColumn("base_spans", in_order(F.concat(*plain)))
    plain_parts = lambda m: m.rlike(JOINTS) & F.forall(F.split(m, JOINTS), lambda part: part.rlike(PLAIN))
    listed = lambda c: reduce(Column.__or__, [c["m"].rlike(p) for p in ALLOWED]) | plain_parts(c["m"])
    inside = lambda c: F.exists("base_spans", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    found = found.withColumn("__candidates", F.filter("__candidates", lambda c: ~listed(c)))
    found = found.withColumn("__candidates", F.filter(F.transform("__candidates", _entropy_span), lambda s: s.isNotNull() & ~inside(s)))
    return found.select(*columns, F.col("base_spans").cast(_SPAN).alias("base_spans"), in_order(F.concat("base_spans", "__candidates")).cast(_SPAN).alias("spans"))


def spelled(spans: str | Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The result of :func:`scan` with every span of the text replaced by ``mask`` and without the span columns; spans
    that touch or overlap become one. Texts without spans, null ones included, stay as they are."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc: Column, s: Column) -> Column:
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        joined = lambda last: F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        touches = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"])
        return F.when(touches, joined(F.get(acc, F.size(acc) - 1))).otherwise(F.array_append(acc, own))

    merged = scanned.withColumn("__merged", F.aggregate("spans", none, add))
    starts = F.concat(F.transform("__merged", lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("__merged", lambda s: s["end"]))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.size("__merged") > 0, F.array_join(pieces, mask)).otherwise(F.col(text))
    return merged.withColumn(text, clean).drop("__merged", "base_spans", "spans")
