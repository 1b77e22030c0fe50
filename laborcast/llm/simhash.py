"""Near duplicates by SimHash fingerprints and a binary-trie self-join.

A fingerprint has a bit set if more than half of the text's shingle hashes have it. Two fingerprints that differ in few
bits agree in whole blocks of bits, so distinct fingerprints first meet on the blocks they share. Inside such a group the
sorted fingerprints are a binary trie whose nodes are ranges; pairs of nodes go down together, one bit at a time, gather
the bits that differ and are dropped when these exceed the budget.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import cut, extended, slices, with_columns, without

#: Bits in which linked fingerprints may differ.
DISTANCE = 3
#: The first grouping: a pair within the distance agrees in all bits of two of the blocks.
BLOCKS = 5
#: A group of more fingerprints than this is divided again by further blocks.
GROUP = 1 << 16
#: Node pairs that a task holds at once.
FRONTIER = 1 << 19
_WORDS = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """The 64-bit fingerprint of a text: words in lower case (A-Z only), ``width`` to a shingle, repeats included.

    A text with fewer words is one shingle; without words the fingerprint is zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for start in range(0, total, _WORDS):
        part = words[start:min(start + _WORDS, total) + width - 1]
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(part[i:] for i in range(width))))], dtype=np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a long column ``name`` (the 64 bits in two's complement), which replaces a column
    of that name. A null text counts as empty. Every row is kept."""
    source = without(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            values = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            yield with_columns(part, **{name: pa.array(values)})

    return source.mapInArrow(run, extended(source, T.StructField(name, T.LongType(), False)))


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``parts`` even blocks of ``width`` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def first_masks(distance: int) -> list[int]:
    """Masks of the first grouping: all choices of the blocks that must agree."""
    blocks = [((1 << n) - 1) << at for at, n in _cuts(64, max(BLOCKS, distance + 2))]
    return [sum(c) for c in combinations(blocks, len(blocks) - distance)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """``mask`` with one more block of the bits it leaves free, for each block that may be the one that agrees."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << free[i] for i in range(at, at + n)) for at, n in _cuts(len(free), distance + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def trie_pairs(values: np.ndarray, groups: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values of one group that differ in 1 to ``distance`` bits.

    ``values`` (unsigned) are distinct and ascending inside each group, ``groups`` has where each group starts.
    A node is a range of the array; a pair of nodes is (start, end, start, end, bit, differing bits).
    """
    ends = np.append(groups[1:], len(values))
    own = ends - groups > 1
    lo, hi = groups[own], ends[own]
    stack = [(lo, hi, lo, hi, np.full(len(lo), 63), np.zeros(len(lo), np.int64))]
    while stack:
        a, b, c, d, bit, spent = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack.append(tuple(x[:half] for x in (a, b, c, d, bit, spent)))
            stack.append(tuple(x[half:] for x in (a, b, c, d, bit, spent)))
            continue
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            x, y = a[single], c[single]
            differ = np.bitwise_count(values[x] ^ values[y])
            near = (x != y) & (differ <= distance)
            if near.any():
                yield x[near], y[near]
            a, b, c, d, bit, spent = (v[~single] for v in (a, b, c, d, bit, spent))
        if not len(a):
            continue
        middle = _split(values, a, b, bit)
        same = a == c
        middle2 = np.where(same, middle, _split(values, c, d, bit))
        parts = []
        for x0, x1, y0, y1, cost, keep in (
                (a, middle, c, middle2, 0, None), (middle, b, middle2, d, 0, None),
                (a, middle, middle2, d, 1, None), (middle, b, c, middle2, 1, ~same)):
            alive = (x1 > x0) & (y1 > y0) & (spent + cost <= distance)
            if keep is not None:
                alive &= keep
            alive &= ~((x0 == y0) & (x1 - x0 == 1))
            parts.append((x0[alive], x1[alive], y0[alive], y1[alive], bit[alive] - 1, spent[alive] + cost))
        child = tuple(np.concatenate(p) for p in zip(*parts))
        if len(child[0]):
            stack.append(child)


def _split(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the bit turns from 0 to 1 inside ranges whose higher bits are equal, by bisection of all ranges at once."""
    lo, hi = start.copy(), end.copy()
    shift = bit.astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        middle = (lo + hi) // 2
        one = (values[np.minimum(middle, len(values) - 1)] >> shift & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, middle, hi)
        lo = np.where(open_ & ~one, middle + 1, lo)


def _least_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the edges."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        for side in (x, y):
            np.minimum.at(label, before[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            return label


def spanning(n: int, x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indices of the edges of a spanning forest of least cost (Boruvka's rounds; of equal costs the first edge)."""
    order = np.argsort(cost, kind="stable")
    x, y, rank = x[order], y[order], np.arange(len(order))
    label, chosen = np.arange(n), []
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)
        x, y, rank, a, b = x[open_], y[open_], rank[open_], a[open_], b[open_]
        best = np.full(n, len(order))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        picked = np.unique(best[best < len(order)])
        chosen.append(picked)
        at = np.searchsorted(rank, picked)
        label = _least_labels(n, a[at], b[at])[label]


def _forest(values: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values of one group that differ in up to ``distance`` bits: of all such pairs a spanning forest of the nearest."""
    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for more in held:
            x, y = np.append(x, more[0]), np.append(y, more[1])
        keep = spanning(len(values), x, y, np.bitwise_count(values[x] ^ values[y]))
        return x[keep], y[keep]

    for pair in trie_pairs(values, starts, distance):
        held.append(pair)
        if sum(len(p[0]) for p in held) > 2 * FRONTIER:
            x, y = reduced(x, y)
            held.clear()
    return reduced(x, y) if held else (x, y)


def _join_groups(distance: int):
    """Links inside groups, from rows (which, key, fp) sorted by all three; the rows of a group above GROUP are handed on."""
    names = ["which", "a", "b", "linked"]

    def links(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        which, key, values = (np.concatenate(x) for x in zip(*held))
        values = values.view(np.uint64)
        order = np.lexsort((values, key, which))
        which, key, values = which[order], key[order], values[order]
        a, b = _forest(values, np.flatnonzero(_changes(which, key)), distance)
        return pa.RecordBatch.from_arrays([pa.array(which[a]), pa.array(values[a].view(np.int64)), pa.array(values[b].view(np.int64)), pa.array(np.ones(len(a), bool))], names=names)

    def deferred(which: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(np.zeros(len(fp), bool))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole groups
        tail: list[tuple[np.ndarray, ...]] = []  # what there is so far of the last group
        last, large = None, False
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if not len(columns[0]):
                continue
            starts = np.flatnonzero(_changes(*columns[:2]))
            edges = [*starts[:2], *starts[-1:], len(columns[0])]  # the first group, those between, the last group
            for start, end in zip(edges, edges[1:]):
                if start >= end:
                    continue
                which, key, fp = part = tuple(c[start:end] for c in columns)
                if last != (which[0], key[0]):
                    if not large:
                        held += tail
                        size += sum(len(t[0]) for t in tail)
                    tail, large = [], False
                    if size >= GROUP:
                        yield links(held)
                        held, size = [], 0
                last = (which[-1], key[-1])
                if large:
                    yield deferred(which, fp)
                    continue
                tail.append(part)
                if last == (which[0], key[0]) and sum(len(t[0]) for t in tail) > GROUP:
                    for t in tail:
                        yield deferred(t[0], t[2])
                    tail, large = [], True
        if not large:
            held += tail
        if held:
            yield links(held)

    return run


def _changes(which: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.append(True, (key[1:] != key[:-1]) | (which[1:] != which[:-1]))


def fingerprint_links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(tab, a, b): links between distinct fingerprints of one table that differ in ``distance`` bits or fewer.

    ``fingerprints`` has the columns tab (an int below 100) and fingerprint. The links join the same fingerprints as all
    such pairs do, and each is such a pair; but a group of many near fingerprints gives a spanning forest of its nearest
    pairs, not every pair. Groups above GROUP are divided by a further block of bits, round by round, until the bits left
    free bound their size, so no task holds a large group and nothing is left out.
    """
    masks = first_masks(distance)
    rows = fingerprints.select("tab", F.col("fingerprint").alias("fp")).where("fp is not null").distinct()
    keyed = rows.select(F.explode(F.array(*[F.lit(100 * i) for i in range(len(masks))])).alias("m"), "tab", "fp").select((F.col("m") + F.col("tab")).cast("long").alias("which"), "fp")
    done: DataFrame | None = None
    while True:
        mask = F.array(*[F.lit(_signed(m)) for m in masks])[F.floor(F.col("which") / 100).cast("int")]
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(mask)).select("which", "key", "fp")
        found = cut(keyed.repartition("which", "key").sortWithinPartitions("which", "key").mapInArrow(_join_groups(distance), "which long, a long, b long, linked boolean"))
        links = found.where("linked").select((F.col("which") % 100).alias("tab"), "a", "b")
        done = links if done is None else done.unionAll(links)
        rest = found.where("NOT linked")
        left = sorted(r.m for r in rest.select(F.floor(F.col("which") / 100).cast("int").alias("m")).distinct().collect())  # a few masks, not rows
        if not left:
            return done.distinct()
        finer, number = [], []
        for m in left:
            own = finer_masks(masks[m], distance)
            number += [F.lit(m), F.array(*[F.lit(100 * (len(finer) + i)) for i in range(len(own))])]
            finer += own
        masks = finer
        keyed = rest.select(F.explode(F.create_map(*number)[F.floor(F.col("which") / 100).cast("int")]).alias("m"), (F.col("which") % 100).alias("tab"), F.col("a").alias("fp"))
        keyed = keyed.select((F.col("m") + F.col("tab")).cast("long").alias("which"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(``key``, fingerprint, component): the fingerprint of every document and the smallest key that it reaches over links.

    Equal fingerprints are one class before anything is joined, so copies are never compared. A null or empty text has
    the fingerprint zero and is linked like any other. A null key gives a row whose component is the smallest key of its
    group, null if the group has none; repeated rows each give a row. No rows give no rows.
    """
    prints = cut(with_fingerprints(docs.select(F.col(key), F.col(text)), text, width).select(key, "fingerprint"))
    classes = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    roots = components(fingerprint_links(classes.withColumn("tab", F.lit(0)), distance), "a", "b")
    members = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    groups = members.groupBy("root").agg(F.min("least").alias("component"))
    moved = members.join(groups, "root").select("fingerprint", "component")
    alone = classes.select("fingerprint", "least").join(moved, "fingerprint", "left")
    component = cut(alone.select("fingerprint", F.coalesce("component", "least").alias("component")))  # so that the join can split a hot fingerprint
    return prints.join(component, "fingerprint").select(key, "fingerprint", "component")


#: The second use, :func:`deduplicated`: independent fingerprints of the sets of words, in as many tables, bring together
#: most texts that differ in a few words; which of them are near duplicates is then decided on the texts. An exact join
#: over prefixes of the shingle sets finds the pairs that the fingerprints leave.
TABLES, SHINGLE, SIMILAR = 8, 5, 0.8
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) for i in range(TABLES)], dtype=np.uint64)
#: Cells of the shingle counts, which only order the shingles, and how many travel as one row.
CELLS, _CELL_ROW = 1 << 20, 1 << 12
#: Cells of a sketch, and pairs of sketches that are compared at once.
SKETCH, _COMPARED = 256, 1 << 14


def word_prints(text: str) -> np.ndarray:
    """One fingerprint for each table, of the set of words in lower case (A-Z only); all zero without words."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    ones = np.zeros((TABLES, 64), dtype=np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    for start in range(0, len(h), 4096):
        x = h[start:start + 4096] ^ _SEEDS[:, None]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(TABLES, -1, 8), axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1).view(">u8").ravel().astype(np.uint64) if len(h) else np.zeros(TABLES, np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles of SHINGLE words in lower case; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    width = max(1, min(SHINGLE, len(words)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), 7) for w in zip(*(words[i:] for i in range(width)))), np.uint64)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _digest(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return hashes & (CELLS - 1)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each cell."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for _, own in slices(batches, "text"):
            total += np.bincount(_cell(np.concatenate([shingle_set(t) for t in own])), minlength=CELLS) if own else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(CELLS // _CELL_ROW), pa.int64()), pa.array(list(total.reshape(-1, _CELL_ROW)), pa.list_(pa.int64()))], names=["at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[at] = total.get(at, 0) + n.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["at", "n"])

    out = np.zeros((CELLS // _CELL_ROW, _CELL_ROW), dtype=np.int64)
    for r in texts.select("text").mapInArrow(count, "at long, n array<long>").repartition("at").mapInArrow(add, "at long, n array<long>").toArrow().to_batches():
        for at, n in zip(r.column(0).to_pylist(), r.column(1)):
            out[at] = n.values.to_numpy()
    return out.ravel()


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a set, by the count of their cell: so many that another set with a similarity of SIMILAR has one
    of them among its own first. A set without elements has a stand-in.

    Such a pair shares SIMILAR of the larger set at least; if no first one were shared, fewer would be left to share.
    """
    if not len(hashes):
        return np.zeros(1, np.int64)
    take = len(hashes) - math.ceil(SIMILAR * len(hashes) - 1e-9) + 1
    return hashes[np.argsort(counts[_cell(hashes)], kind="stable")[:take]]  # equal counts stay in the order of the hashes


def most_shared(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int, counts: np.ndarray) -> int:
    """How many elements two sets can share by their prefixes: those seen in both, and all others up to the smaller rest.

    Up to the end of the prefix that ends first both sets are known.
    """
    ends = [(counts[_cell(x[-1])], np.uint64(x[-1].astype(np.uint64))) for x in (a, b)]
    count, last = min(ends)
    rest = []
    for x, size in ((a, size_a), (b, size_b)):
        n, h = counts[_cell(x)], x.view(np.uint64)
        rest.append(size - int(((n < count) | (n == count) & (h <= last)).sum()))
    return len(np.intersect1d(a, b, assume_unique=True)) + min(rest)


def sketch(hashes: np.ndarray) -> bytes | None:
    """How many elements of a set fall into each of SKETCH cells, one byte each; None if a byte can't hold a count."""
    counts = np.bincount(hashes >> np.int64(32) & np.int64(SKETCH - 1), minlength=SKETCH)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _sketches(column: pa.Array) -> np.ndarray:
    """Sketches as rows; a null is a row of the largest counts."""
    filled = [b"\xff" * SKETCH if x is None else x for x in column.to_pylist()]
    return np.frombuffer(b"".join(filled), dtype=np.uint8).reshape(-1, SKETCH)


def _sketch_allows(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with these sketches, row by row, can have a similarity of SIMILAR: they share no more elements than the
    smaller counts of all cells. ``sizes`` are those of both sets together. Two sets without a sketch always can."""
    shared = np.concatenate([np.minimum(x[i:i + _COMPARED], y[i:i + _COMPARED]).sum(axis=1, dtype=np.int64) for i in range(0, len(x), _COMPARED)]) if len(x) else np.zeros(0, np.int64)
    return (shared >= SIMILAR / (1 + SIMILAR) * sizes - 1e-6) | (shared == 255 * SKETCH)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (h, node, size, pos), sorted by h, whose h another row has too."""
    names, kept, had = ["h", "node", "size", "pos"], None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(4)]
        if kept is not None:
            columns = [np.append(k, c) for k, c in zip(kept, columns)]
        same = columns[0][1:] == columns[0][:-1]
        before = np.append(had, same)
        keep = before[:-1] | same
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in columns], names=names)
        kept, had = [c[-1:] for c in columns], bool(before[-1])
    if had:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=names)


def _group_pairs(every: bool):
    """Pairs (a, b) of nodes that one h brings together and whose sizes and places allow a similarity of SIMILAR, from rows
    (h, node, size, pos, root) sorted by h: those next to each other by size; or, with ``every`` and a sixth column sketch, all
    those with different roots. Their sketches are compared here, so that most pairs of a group that aren't alike are no rows."""
    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, node, size, pos, root, sketches = rows
        order = np.lexsort((node, size, h))
        h, node, size, pos, root, sketches = (x[order] for x in (h, node, size, pos, root, sketches))
        n = len(h)
        ends = np.repeat(np.flatnonzero(np.append(h[1:] != h[:-1], True)) + 1, np.diff(np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), n)))
        if every:
            number = np.cumsum(np.append(0, h[1:] != h[:-1]))
            key = number * (np.int64(1) << 40) + size
            ends = np.minimum(ends, np.searchsorted(key, number * (np.int64(1) << 40) + (size / SIMILAR + 1e-6).astype(np.int64), "right"))
        else:
            ends = np.minimum(ends, np.arange(n) + 2)
        more = np.maximum(ends - np.arange(n) - 1, 0)
        upto = np.cumsum(more)
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + FRONTIER, "right")))
            m = more[start:end]
            x = np.repeat(np.arange(start, end), m)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            start = end
            shared = 1 + np.minimum(size[x] - 1 - pos[x], size[y] - 1 - pos[y])
            good = (root[x] != root[y]) & (shared >= SIMILAR / (1 + SIMILAR) * (size[x] + size[y]) - 1e-6)
            x, y = x[good], y[good]
            if every and len(x):
                alike = np.concatenate([_sketch_allows(sketches[p], sketches[q], size[p] + size[q]) for p, q in (
                    (x[i:i + _COMPARED], y[i:i + _COMPARED]) for i in range(0, len(x), _COMPARED))])
                x, y = x[alike], y[alike]
            x, y = node[x], node[y]
            if len(x):
                a, b = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [*(batch.column(i).to_numpy() for i in range(5)), _sketches(batch.column(5)) if every else np.empty((batch.num_rows, 0), np.uint8)]
            changes = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            if held and rows[0][0] != held[-1][0][-1]:
                cuts = [0, *changes[-1:]]
            else:
                cuts = [*changes[-1:]]
            if cuts:  # what comes before the batch's last group is whole
                ready = [np.concatenate(c) for c in zip(*held, [r[:cuts[-1]] for r in rows])]
                yield from pairs(ready)
                held = []
                rows = [r[cuts[-1]:] for r in rows]
            held.append(rows)
        if held:
            yield from pairs([np.concatenate(c) for c in zip(*held)])

    return run


def print_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): nodes with fingerprints near each other, from rows (node, prints) with one fingerprint for each table. Equal
    fingerprints give a chain, near ones what :func:`fingerprint_links` gives."""
    tables = cut(prints.select("node", F.posexplode("prints").alias("tab", "fingerprint")))
    same = Window.partitionBy("tab", "fingerprint").orderBy("node")
    chain = tables.withColumn("b", F.lag("node").over(same)).where("b is not null").select(F.col("node").alias("a"), "b")
    names = tables.groupBy("tab", "fingerprint").agg(F.min("node").alias("node"))
    links = fingerprint_links(names)
    for end in ("a", "b"):
        links = links.join(names.select("tab", F.col("fingerprint").alias(end), F.col("node").alias(f"node_{end}")), ["tab", end])
    return links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionAll(chain)


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, counts) -> DataFrame:
    """(a, b): the pairs of nodes whose texts have a similarity of SIMILAR or more.

    ``nodes`` has node, digest, k, size, prefix and sketch, ``rows`` has digest, k and text, once for each node at least. The
    prefixes and sketches rule out most pairs that aren't alike, before texts move; they then move once.
    """
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n, p, q = (batch.column(name) for name in ("m", "n", "x", "y"))
            sums = m.to_numpy().astype(np.int64) + n.to_numpy()
            able = pa.array(_sketch_allows(_sketches(batch.column("s")), _sketches(batch.column("t")), sums), pa.bool_())
            batch, m, n, p, q = (c.filter(able) for c in (batch, m, n, p, q))
            sizes = zip(m.to_pylist(), n.to_pylist())
            keep = [most_shared(x.values.to_numpy(), m, y.values.to_numpy(), n, counts.value) >= SIMILAR / (1 + SIMILAR) * (m + n) - 1e-6 for (m, n), x, y in zip(sizes, p, q)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda *names: nodes.select(*[F.col(c).alias(n) for c, n in zip(("node", "size", "prefix", "sketch"), names)])
    pairs = pairs.join(side("a", "m", "x", "s"), "a").join(side("b", "n", "y", "t"), "b").select("a", "b", "m", "x", "s", "n", "y", "t")
    pairs = cut(pairs.mapInArrow(possible, "a long, b long"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t) for t in own], pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = nodes.select("node", "digest", "k").join(wanted, "node")
    sets = rows.join(wanted, ["digest", "k"]).select("node", "text").mapInArrow(shingled, "node long, shingles array<long>")
    sets = cut(sets.dropDuplicates(["node"]))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            near = [similarity(p.values.to_numpy(), q.values.to_numpy()) >= SIMILAR for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"))


def near_links(nodes: DataFrame, rows: DataFrame, counts) -> DataFrame:
    """(a, b): links that join the same nodes as all pairs of texts with a similarity of SIMILAR or more.

    ``nodes`` and ``rows`` are those of :func:`confirmed`, nodes with prints. Pairs by fingerprints, and pairs next to each other in the groups of the
    prefix join, are checked first. What they join needs no more pairs inside; every pair of the groups that is still
    apart is then checked, so that a check that fails never stands for a pair that was not made.
    """
    places = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "h")).select("h", "node", F.col("size").cast("long").alias("size"), F.col("pos").cast("long").alias("pos"))
    by_h = lambda df: df.repartition("h").sortWithinPartitions("h")
    met = cut(by_h(places).mapInArrow(_met, "h long, node long, size long, pos long"))
    near = by_h(met.withColumn("root", F.col("node"))).mapInArrow(_group_pairs(False), "a long, b long")
    links = confirmed(print_pairs(nodes.select("node", "prints")).unionAll(near), nodes, rows, counts)
    roots = components(links, "a", "b")
    apart = met.join(roots, "node", "left").select("h", "node", "size", "pos", F.coalesce("root", "node").alias("root"))
    several = apart.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("h")
    apart = apart.join(several, "h", "left_semi").join(nodes.select("node", "sketch"), "node").select("h", "node", "size", "pos", "root", "sketch")
    return links.unionAll(confirmed(by_h(apart).mapInArrow(_group_pairs(True), "a long, b long"), nodes, rows, counts))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that with the smallest key, of equal keys any one.

    Texts are linked if their sets of shingles of SHINGLE words (lower case, A-Z only) have a similarity of SIMILAR or
    more, and a group is what links reach; equal texts, null and empty ones together, are one from the start. A null key
    counts as larger than any other. The columns stay as they are; no rows give no rows.
    """
    number = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(number.alias("k"), _digest(text).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches, "text"):
            prints = pa.array([word_prints(t).view(np.int64) for t in own], pa.list_(pa.int64()))
            sets = [shingle_set(t) for t in own]
            first = pa.array([prefix(s, counts.value) for s in sets], pa.list_(pa.int64()))
            cells = pa.array(map(sketch, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], prints, pa.array(map(len, sets), pa.int32()), first, cells], names=["k", "digest", "prints", "size", "prefix", "sketch"])

    prints = rows.mapInArrow(printed, "k long, digest string, prints array<long>, size int, prefix array<long>, sketch binary")
    nodes = cut(prints.groupBy("digest").agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in ("prints", "size", "prefix", "sketch")]).withColumn("node", F.xxhash64("digest")))
    roots = components(near_links(nodes, rows, counts), "a", "b")
    grouped = cut(nodes.select("digest", "k", "node").join(roots, "node"))
    first = grouped.groupBy("root").agg(F.min(F.struct("k", "digest")).alias("first"))
    gone = grouped.join(first, "root").where(F.struct("k", "digest") != F.col("first")).select("digest")
    kept = cut(nodes.select("digest", "k").join(gone, "digest", "left_anti"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(*columns, _digest(text).alias("__digest"), number.alias("__k"))
    kept = kept.select(F.col("digest").alias("__digest"), F.col("k").alias("__k"))
    # Copies of the row kept are few unless rows repeat as a whole; of those one stays.
    return named.join(kept, ["__digest", "__k"], "left_semi").dropDuplicates(["__digest", "__k"]).select(*columns)
