"""Personal data in texts: patterns, and a semi-Markov conditional random field for what the patterns can't spell.

Base spans come from four patterns. Around digits and signs of an address, :func:`lattices` proposes every segment of at
most GROUPS groups of digits, or of one address with at most LABELS labels; features of the whole segment (digits, groups,
separators, checksum, what stands beside it) score it, and :class:`laborcast.llm.segments.Model` chooses boundaries and
types together. So ``743-555-3824``, ``ann [at] host [dot] org`` or two card numbers in a row are found, which no pattern is.

The field is trained on spans of the corpus itself: base spans, the same spans rewritten in other spellings, and numbers
that are no personal data, each in the surroundings where it was found.
"""
from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import Lattice, Model, fit
from .shared import cut, extended, slices, with_columns, without

#: The base patterns. A start inside a run of the first group's characters can't match if the run's start doesn't, so runs are entered once.
KINDS = ["email", "ip", "card", "phone"]
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The model is fitted on at most this many spans of the corpus, those with the smallest hashes, and BESIDE characters on each side.
TRAIN_SPANS, BESIDE = 1500, 24
#: A candidate has at most this many groups of digits, or labels after the sign of an address, and characters (an address, before the sign).
GROUPS, LABELS, LONGEST = 9, 6, 80
#: Hosts and endings of the addresses that training makes up beside the corpus's own.
HOSTS, ENDINGS = ["mail", "host", "corp-a", "uni2", "web"], ["com", "org", "net", "de", "info", "io"]
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_NUMBERS = re.compile(r"[0-9]+")
_JOINT = re.compile(r"[\x20().\-/:\[\]]{1,4}")
_AT = re.compile(r"\x20?@\x20?|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20", re.IGNORECASE)
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)"
_FIRST = re.compile(r"[A-Za-z0-9-]+")
_LABEL = re.compile(rf"{_DOT}([A-Za-z0-9-]+)", re.IGNORECASE)
_SPELLED = re.compile(r"[\[({\x20]dot[\])}\x20]|[\[({]\x20?at\x20?[\])}]|[\[({]\.[\])}]|@", re.IGNORECASE)
_CUES = re.compile(r"(tel|phone|mobile|fax|call|card|visa|credit|pay|ip|host|server|address|mail|contact|version|page|price|total|date|order|invoice|id|no)\W{0,3}$", re.IGNORECASE)
Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUMBERS.findall(text))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern that pass its check, by start and kind; failing matches are dropped."""
    out = []
    sign, done = text.find("@"), 0
    while sign >= 0:  # an address is found from its sign: the longest run before it, not before the last match's end
        start = sign
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, sign) if start < sign else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        else:
            done = max(done, sign)  # a run never passes a sign
        sign = text.find("@", max(done, sign + 1))
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _side(c: str) -> str:
    return "edge" if not c else "digit" if c in "0123456789" else "letter" if c.isalnum() else "space" if c.isspace() else c if c < "\x7f" else "sign"


def _beside(text: str, a: int, b: int) -> list[str]:
    left, right = text[max(0, a - 2):a], text[b:b + 2]
    cue = _CUES.search(text, max(0, a - 12), a)
    return [f"left {_side(left[-1:])}", f"right {_side(right[:1])}", f"left2 {_side(left[:1])} {_side(left[-1:])}", f"right2 {_side(right[:1])} {_side(right[1:])}",
            f"cue {cue[1].lower() if cue else ''}"]


def _number_features(text: str, a: int, b: int) -> list[str]:
    piece = text[a:b]
    groups, joints = _NUMBERS.findall(piece), _NUMBERS.split(piece)
    digits = "".join(groups)
    inner = joints[1:-1]
    plus = joints[0] if joints[0] else "00" if digits.startswith("00") else ""
    kinds = "|".join(sorted(set(inner)))
    lengths = "-".join(str(min(len(g), 20)) for g in groups)
    out = ["number", f"digits {min(len(digits), 20)}", f"groups {len(groups)}", f"lengths {lengths}", f"joints {kinds}", f"head {plus}", f"head {plus} lengths {lengths}",
           f"head {plus} digits {min(len(digits), 20)}", f"joints {kinds} lengths {lengths}"]
    if 13 <= len(digits) <= 19:
        out += [f"luhn {luhn(digits)}", f"luhn {luhn(digits)} groups {len(groups)}"]
    if len(groups) == 4:
        out.append(f"octets {all(map(_small, groups))} {kinds}")
    return out + _beside(text, a, b)


def _address_features(text: str, a: int, b: int, at: str, labels: list[str], joints: set[str]) -> list[str]:
    last = labels[-1]
    ending = f"{min(len(last), 5)}{'a' if last.isalpha() else 'n'}"
    tight = at.strip() == at and all(j.strip() == j for j in joints)
    spelled = "|".join(sorted({j.strip().lower() for j in joints}))
    local = text[a:text.index(at, a)]
    name = "marked" if re.search(r"[A-Za-z0-9][._%+-][A-Za-z0-9]|[0-9]", local) else "word"
    return ["address", f"at {at.lower()}", f"dots {spelled}", f"at {at.strip().lower()} dots {spelled}", f"labels {len(labels)}", f"ending {ending}", f"at {at.strip().lower()} ending {ending}",
            f"tight {tight}", f"name {name}", f"name {name} at {at.lower()}", f"labels {len(labels)} at {at.lower()}", *_beside(text, a, b)]


def _kinds_of(piece: str) -> tuple[int, ...]:
    """The kinds that a piece with these digits can be at all."""
    groups = _NUMBERS.findall(piece)
    n = sum(map(len, groups))
    able = []
    if len(groups) == 4 and len(set(_NUMBERS.split(piece)[1:-1])) == 1 and "." in piece and all(map(_small, groups)):
        able.append(1)
    if 13 <= n <= 19 and luhn("".join(groups)):
        able.append(2)
    if 10 <= n <= 15:
        able.append(3)
    return tuple(able)


def _number_candidates(text: str) -> Iterator[tuple[int, int, list[str], tuple[int, ...]]]:
    def of_chain(chain: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str], tuple[int, ...]]]:
        for i, (a, _) in enumerate(chain):
            starts = [a, *[a - len(mark) for mark in ("+", "(", "+(") if text.startswith(mark, max(0, a - len(mark)), a)]]
            for _, b in chain[i:i + GROUPS]:
                if b - a > LONGEST:
                    break
                if able := _kinds_of(text[a:b]):
                    yield from ((start, b, _number_features(text, start, b), able) for start in starts)

    chain: list[tuple[int, int]] = []
    for m in _NUMBERS.finditer(text):
        before, after = text[m.start() - 1:m.start()], text[m.end():m.end() + 1]
        if before.isalpha() or before == "_" or after.isalpha() or after == "_":  # part of a word or code
            yield from of_chain(chain)
            chain = []
            continue
        if chain and not _JOINT.fullmatch(text, chain[-1][1], m.start()):
            yield from of_chain(chain)
            chain = []
        chain.append((m.start(), m.end()))
    yield from of_chain(chain)


def _address_candidates(text: str) -> Iterator[tuple[int, int, list[str], tuple[int, ...]]]:
    for m in _AT.finditer(text):
        a = m.start()
        while a > 0 and m.start() - a < LONGEST and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        first = _FIRST.match(text, m.end())
        if a == m.start() or not first:
            continue
        labels, joints, b = [first[0]], set(), first.end()
        while len(labels) < LABELS and (more := _LABEL.match(text, b)):
            joints.add(text[b:more.start(1)])
            labels.append(more[1])
            b = more.end()
            yield a, b, _address_features(text, a, b, m[0], labels, joints), (0,)


def lattices(text: str, taken: Iterable[Span] = ()) -> Iterator[Lattice]:
    """The candidate segments of a text, in lattices that don't touch each other; candidates that overlap ``taken`` are left out."""
    found = list(_number_candidates(text))
    if _SPELLED.search(text):
        found += _address_candidates(text)
    taken = sorted((s, e) for s, _, e in taken)
    found.sort(key=lambda c: (c[0], c[1]))
    group: list = []
    reach, t = -1, 0
    longest = max((e - s for s, e in taken), default=0)
    for c in found:
        while t < len(taken) and taken[t][0] + longest <= c[0]:
            t += 1
        k, free = t, True
        while k < len(taken) and taken[k][0] < c[1]:
            if taken[k][1] > c[0]:
                free = False
                break
            k += 1
        if not free:
            continue
        if group and c[0] >= reach:
            yield Lattice(group)
            group = []
        group.append(c)
        reach = max(reach, c[1])
    if group:
        yield Lattice(group)


def _rewritten(kind: int, span: str, rng: random.Random) -> list[str]:
    """Other spellings of a base span, each still of its kind."""
    digits = _digits(span)
    if kind == 0:
        name, host = span.split("@", 1)
        name = rng.choice([name, re.sub(r"[^A-Za-z].*", "", name) or name])
        host = rng.choice([host, host, ".".join(host.split(".")[-2:]), f"{rng.choice(HOSTS)}.{rng.choice(ENDINGS)}"])
        open_, close = rng.choice(["[]", "()", "{}"])
        return [f"{name} {open_}at{close} {host.replace('.', f' {open_}dot{close} ')}", f"{name}{open_}at{close}{host}", f"{name} at {host.replace('.', ' dot ')}", f"{name} @ {host}",
                f"{name}@{host.replace('.', f'{open_}dot{close}')}"]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", "(.)")]
    if kind == 2:
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours), "  ".join(fours), f"{digits} {digits}"]
    area, middle, end = digits[-10:-7], digits[-7:-4], digits[-4:]
    country = digits[:-10] or "1"
    return [f"({area}) {middle}-{end}", f"{area}-{middle}-{end}", f"{area}.{middle}.{end}", f"{country}-{area}-{middle}-{end}", f"{area} {middle} {end}", f"{country} {area} {middle} {end}", f"00{country} {area} {middle}{end}",
            f"+{country}/{area}/{middle}{end}"]


def _harmless(rng: random.Random) -> str:
    """A number or a phrase that is no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    year, month, day = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)

    def unchecked(k: int) -> str:
        while luhn(d := rng.choice("123456789") + n(k - 1)):
            pass
        return d

    return rng.choice([
        f"{year}-{month:02}-{day:02}", f"{day}/{month}/{year}", f"{day:02}.{month:02}.{year}", f"{year}-{month:02}-{day:02} {day:02}:{month:02}:30", f"{rng.randint(1, 9)},{n(3)},{n(3)}.{n(2)}",
        f"{year}-{year + 1}", f"{n(3)}-{n(3)}", f"{n(7)}", f"{n(8)}", f"{n(9)}", f"{n(10)}", f"{n(11)}", f"{n(12)}", f"#{n(6)}-{n(2)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", unchecked(16), unchecked(15),
        " ".join(re.findall("....", unchecked(16))), "-".join(re.findall("....", unchecked(16))), f"{n(4)} {n(4)}", f"{n(5)}-{n(4)}", f"{n(1)}.{n(2)}.{n(1)}", f"{n(2)}:{n(2)}:{n(2)}.{n(3)}",
        f"{n(3)} {n(3)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", f"{year} {year + 1} {year + 2}", f"{n(2)}.{n(5)}, {n(2)}.{n(5)}", f"3.{n(12)}", f"{n(13)}", f"{n(6)}/{n(6)}", f"{n(20)}", f"{n(24)}",
        "look at the dot com", "at noon", "aim at this dot", "met at home dot", f"@{rng.choice(['home', 'work'])} now", "a @ b", f"{n(3)}.{n(3)}", f"{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}",
    ])


def examples(spans: list[tuple[str, str, int, str]], seed: int = 12) -> list[Lattice]:
    """Labelled lattices from (left side, span, kind, right side): the span, other spellings of it, and harmless numbers in its place."""
    rng = random.Random(seed)
    out = []

    def add(left: str, pieces: list[tuple[str, int | None]], right: str) -> None:
        text, gold = left, set()
        for piece, kind in pieces:
            if kind is not None:
                gold.add((len(text), len(text) + len(piece), kind))
            text += piece
        for lattice in lattices(text + right):
            place = {c[:2]: i for i, c in enumerate(lattice.candidates)}
            here = [g for g in gold if g[:2] in place]
            low, high = lattice.candidates[0][0], max(c[1] for c in lattice.candidates)
            if low < len(left) or high > len(text) or any(g[0] < high and low < g[1] and g not in here for g in gold):
                continue  # reaches into the surroundings, or holds a span that no candidate spells
            out.append(Lattice(lattice.candidates, [(place[g[:2]], g[2]) for g in here]))

    for left, span, kind, right in spans:
        tight = left[-1:].isalnum() or right[:1].isalnum()
        left, right = (left + " ", " " + right) if tight else (left, right)
        add(left, [(span, kind)], right)
        for other in rng.sample(spelled := _rewritten(kind, span, rng), min(3, len(spelled))):
            half = len(other) // 2
            pieces = [(other[:half], kind), (" ", None), (other[half + 1:], kind)] if kind == 2 and other[:half] == other[half + 1:] else [(other, kind)]
            add(left, pieces, right)
        for _ in range(4):
            add(left, [(_harmless(rng), None)], right)
        if rng.random() < .2:
            next_left, next_span, next_kind, _ = rng.choice(spans)
            add(left, [(span, kind), (" ", None), (next_span, next_kind)], right)
    return out


def _seeds() -> list[tuple[str, str, int, str]]:
    """Spans for training where the corpus has none: one of each kind, from numbers kept for documentation."""
    return [("write to ", "ann.lee@mail.example.com", 0, " today"), ("from ", "192.0.2.17", 1, " today"), ("paid by ", "4111111111111111", 2, " today"), ("call ", "+1 (212) 555-0143", 3, " today")]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fits the field on TRAIN_SPANS base spans of all documents, those with the smallest hashes of their surroundings (equal ones count once)."""
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(iter([batch]), "text"):
                rows = [(t[max(0, a - BESIDE):a], t[a:b], k, t[b:b + BESIDE]) for t in texts if _worth(t) for a, k, b in base_spans(t) if b - a <= 200]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["left", "span", "kind", "right"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(spans, "left string, span string, kind int, right string").distinct()
    dealt = F.pmod(F.xxhash64("left", "span", "kind", "right"), F.lit(1 << 30))
    counts = cut(found.withColumn("dealt", dealt))
    share = min(1.0, 2 * TRAIN_SPANS / max(1, counts.count()))  # so that few rows are sorted
    rows = counts.where(F.col("dealt") <= int(share * (1 << 30))).orderBy("dealt", "left", "span", "kind", "right").limit(TRAIN_SPANS).collect()
    return fit(examples([(r["left"], r["span"], r["kind"], r["right"]) for r in rows] + _seeds()), len(KINDS))


def _worth(text: str) -> bool:
    """Whether a text has a digit or a sign of an address at all."""
    return _NUMBERS.search(text) is not None or _SPELLED.search(text) is not None


def found_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text, by start and kind."""
    if not _worth(text):
        return [], []
    base = base_spans(text)
    more = [(a, kind, b) for lattice in lattices(text, base) for a, b, kind in model.decode(lattice)]
    return base, sorted(base + more)


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans``, arrays of (kind, start, end) in code points, end exclusive, by start and then kind.

    Whole texts are read; null and empty ones have no spans. Base spans stay, and what the field adds overlaps none of them.
    Every row is judged by its own text, so equal rows have equal spans; an empty table stays empty. All columns of ``docs``
    stay, but those with one of the two names are replaced. Lazy, without a shuffle; time and memory are linear in a text.
    """
    docs = without(docs, "base_spans", "spans")
    kind = T._parse_datatype_string(_SPAN)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            both = [found_spans(t, model) for t in texts]
            named = [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in column] for column in zip(*both)] or [[], []]
            yield with_columns(part, base_spans=pa.array(named[0], arrow), spans=pa.array(named[1], arrow))

    return docs.mapInArrow(add, extended(docs, T.StructField("base_spans", kind), T.StructField("spans", kind)))


def masked(scanned: DataFrame, text: str = "text") -> DataFrame:
    """``scanned`` with every span of the text replaced by its kind in brackets; of overlapping spans the first covers the others' start.

    The two columns of spans are dropped. A null text stays null.
    """
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, span: Column) -> Column:
        between = F.substring(F.col(f"`{text}`"), (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        shown = F.concat(acc["out"], between, F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(F.when(span["start"] >= acc["at"], shown).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(f"`{text}`"), (acc["at"] + 1).cast("int"), F.length(F.col(f"`{text}`"))))
    out = F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, rest)).otherwise(F.col(f"`{text}`"))
    return scanned.select(*[out.alias(c) if c == text else F.col(f"`{c}`") for c in scanned.columns if c not in ("base_spans", "spans")])


def spelled(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
