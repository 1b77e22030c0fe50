"""Removal of passages that an earlier document also has, by super-k-mer partitioning.

A window is WIDTH consecutive words, its minimiser the smallest hash of the runs of RUN words in it. Consecutive windows
that share a minimiser are a super-k-mer: they travel as one packed string to the bucket of the minimiser, where equal
windows meet. Most minimisers occur in one document only, so a census of the minimisers alone comes first, and only the
super-k-mers of minimisers that two documents have are packed and sent. In a bucket the strings are sorted by their
smallest document, so the first string that has a window also has the smallest document of that window.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import extended, slices, with_columns, without

WIDTH, RUN = 13, 5
#: Distinct windows that a task remembers of one bucket; windows beyond go on by themselves and are counted by a second grouping.
REMEMBERED = 200_000
#: Windows that one packed string has at most, so that a text of one repeated word is not one row.
LONGEST = 4096
_SHIFT = 20  # a span of words is start << _SHIFT | length
_LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def minimisers(words: list[bytes]) -> np.ndarray:
    """The minimiser of each window, in order; none if there are fewer than WIDTH words. It depends on the window's words only."""
    if len(words) < WIDTH:
        return np.zeros(0, dtype=np.int64)
    h = _mix(np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1))
    n = len(words) - RUN + 1
    runs = np.zeros(n, dtype=np.uint64)
    for j in range(RUN):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    runs = _mix(runs)
    least = runs[:len(words) - WIDTH + 1].copy()
    for j in range(1, WIDTH - RUN + 1):
        np.minimum(least, runs[j:j + len(least)], out=least)
    return least.view(np.int64)


def segments(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, window after the last) of each run of windows with one minimiser."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    end = np.append(start[1:], len(least))
    long = end - start > LONGEST
    if long.any():
        start = np.concatenate([start[~long], *(np.arange(a, b, LONGEST) for a, b in zip(start[long], end[long]))])
        start.sort()
        end = np.append(start[1:], len(least))
    return start, end


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (route, other, state) from (rid, text): which document has which minimiser.

    Documents of one part that share a minimiser are already known to (state 2, with the document as route and the bucket
    as the other); one of them (state 1) stands for them in the bucket, so a minimiser of very many documents sends few
    rows there. State 0 is a document alone in its part. States 0 and 1 have the bucket as route, the document as the other.
    """
    for part, texts in slices(batches, "text", 32 << 20):
        rids = part.column(0).to_numpy()
        buckets = [np.unique(minimisers(t.encode("utf-8", "surrogatepass").split())) for t in texts]
        rid = np.repeat(rids, [len(b) for b in buckets])
        bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
        order = np.lexsort((rid, bucket))
        bucket, rid = bucket[order], rid[order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (rid[1:] != rid[:-1]))[:len(bucket)]
        bucket, rid = bucket[new], rid[new]
        first = np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)]
        alone = first & np.append(first[1:], True)[:len(bucket)]
        state = np.where(alone, 0, np.where(first, 1, 2)).astype(np.int8)
        settled = state == 2
        yield pa.RecordBatch.from_arrays([pa.array(np.where(settled, rid, bucket)), pa.array(np.where(settled, bucket, rid)), pa.array(state)], names=["route", "other", "state"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, bucket) for minimisers of two or more documents, from census rows sorted by route and state descending."""
    open_bucket, waiting, met = None, [], False

    def out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rid, bucket = (np.concatenate(x) for x in zip(*pairs))
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(bucket)], names=["rid", "bucket"])

    for batch in batches:
        bucket, rid, state = (batch.column(i).to_numpy() for i in range(3))
        if not len(bucket):
            continue
        found = [(bucket[state == 2], rid[state == 2])]
        bucket, rid, state = bucket[state != 2], rid[state != 2], state[state != 2]
        if len(bucket):
            if open_bucket == bucket[0] and not met and waiting:  # the row held back may now have company
                bucket, rid, state = np.append(waiting[0][1], bucket), np.append(waiting[0][0], rid), np.append(np.int8(0), state)
            elif open_bucket == bucket[0] and met:
                same = bucket == bucket[0]
                state = np.where(same, np.int8(1), state)
            number = np.cumsum(np.append(True, bucket[1:] != bucket[:-1])) - 1
            n = int(number[-1]) + 1
            low, high = np.full(n, _LAST), np.full(n, -_LAST - 1)
            np.minimum.at(low, number, rid)
            np.maximum.at(high, number, rid)
            known = (low != high) | (np.bincount(number, state == 1, n) > 0)
            keep = known[number]
            found.append((rid[keep], bucket[keep]))
            open_bucket, met = bucket[-1], bool(known[-1])
            waiting = [] if met else [(rid[-1:], bucket[-1:])]
        if any(len(r) for r, _ in found):
            yield out(found)


def _packed(text: str):
    """Rows (bucket, least, packed, places) of the super-k-mers of shared minimisers, from rows with a text that end in
    doc, buckets.

    Equal strings of one part become one row; places has document, row and first word of each, by document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text, 32 << 20):
            column = part.schema.get_field_index
            rids, docs, lists = (part.column(column(c)).to_pylist() for c in ("__rid", "__doc", "__buckets"))
            places: dict[tuple[int, str], list[tuple[int, int, int]]] = {}
            for t, rid, doc, shared in zip(texts, rids, docs, lists):
                words = t.encode("utf-8", "surrogatepass").split()
                least, wanted = minimisers(words), set(shared)
                start, end = segments(least)
                for bucket, a, b in zip(least[start].tolist(), start.tolist(), end.tolist()):
                    if bucket in wanted:
                        places.setdefault((bucket, b" ".join(words[a:b + WIDTH - 1]).decode("utf-8", "surrogatepass")), []).append((doc, rid, a))
            if not places:
                continue
            rows = [sorted(v) for v in places.values()]
            flat = np.array([x for v in rows for place in v for x in place], dtype=np.int64)
            ends = np.append(0, 3 * np.cumsum([len(v) for v in rows]))
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in places], pa.int64()), pa.array(flat[ends[:-1]]), pa.array([k[1] for k in places], pa.string()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["bucket", "least", "packed", "places"])

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (route, rid, span, doc, window) from packed rows sorted by bucket and smallest document.

    Without a window a row is a span of words to remove, on its way to its own row. With one it is a window that the task
    could not remember, on its way to where equal windows meet.
    """
    bucket, seen = None, {}
    for batch in batches:
        ends, values = batch.column(3).offsets.to_pylist(), batch.column(3).values.to_pylist()
        rids, spans, loose = [], [], []
        for i, (own, least, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if own != bucket:
                bucket, seen = own, {}
            words = packed.split(" ")
            firsts = []
            for j in range(len(words) - WIDTH + 1):
                w = " ".join(words[j:j + WIDTH])
                first = seen.get(w)
                if first is None:
                    if len(seen) < REMEMBERED:
                        first = seen[w] = least
                    else:
                        for k in range(ends[i], ends[i + 1], 3):
                            loose.append((values[k + 1], _span(values[k + 2] + j, values[k + 2] + j + WIDTH), values[k], w))
                firsts.append(first)
            later = _runs([f is not None for f in firsts])
            earlier = _runs([f is not None and f < least for f in firsts])
            for k in range(ends[i], ends[i + 1], 3):
                for a, b in later if values[k] > least else earlier:
                    rids.append(values[k + 1])
                    spans.append(_span(values[k + 2] + a, values[k + 2] + b + WIDTH - 1))
        routes = rids + [crc32(x[3].encode("utf-8", "surrogatepass")) for x in loose]
        more = list(zip(*loose)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = (routes, rids + list(more[0]), spans + list(more[1]), [None] * len(rids) + list(more[2]), [None] * len(rids) + list(more[3]))
        if routes:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["route", "rid", "span", "doc", "window"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, span) of the spans, and of the windows that an earlier document has, from judged rows sorted by route, window, document."""
    window, first = None, 0
    for batch in batches:
        keep = []
        for w, doc in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist()):
            if w is not None and w != window:
                window, first = w, doc
            keep.append(w is None or doc > first)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["rid", "span"]).filter(pa.array(keep, pa.bool_()))


def _span(start: int, end: int) -> int:
    return start << _SHIFT | end - start


def _runs(flags: list[bool]) -> list[tuple[int, int]]:
    """(first, after the last) of each run of true flags."""
    out, start = [], None
    for i, flag in enumerate([*flags, False]):
        if flag and start is None:
            start = i
        elif not flag and start is not None:
            out.append((start, i))
            start = None
    return out


def _cleaned(text: str):
    """The rows up to their last three columns (rid, doc, spans) with kept, n_words and n_removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            kept, total, removed = [], [], []
            for t, spans in zip(texts, part.column(part.num_columns - 1)):
                words = t.encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if not spans.is_valid:
                    removed.append(0)
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    continue
                found = spans.values.to_numpy()
                start = found >> _SHIFT
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + (found & ((1 << _SHIFT) - 1)), -1)
                stays = np.cumsum(change[:-1]) == 0
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(compress(words, stays.tolist())).decode("utf-8", "surrogatepass"))
            plain = pa.RecordBatch.from_arrays(part.columns[:-3], names=part.schema.names[:-3])
            yield with_columns(plain, kept=pa.array(kept, pa.string()), n_words=pa.array(total, pa.int64()), n_removed=pa.array(removed, pa.int64()))

    return run


def _sorted(rows: DataFrame, key: str, *then: str | Column) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *then)


def spans(keyed: DataFrame, text: str) -> DataFrame:
    """(__rid, __spans): the words to remove, for rows with a text, __rid and __doc."""
    census = keyed.select(F.col("__rid").alias("rid"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(_census, "route long, other long, state byte")
    shared = _sorted(census, "route", F.desc("state")).mapInArrow(_shared, "rid long, bucket long")
    lists = shared.repartition("rid").groupBy(F.col("rid").alias("__rid")).agg(F.collect_set("bucket").alias("__buckets"))  # no more than a text has windows
    # All columns go into the task, so that this join and the last one read the same exchange of the texts.
    packed = keyed.join(lists, "__rid").select(*[F.col(f"`{c}`") for c in keyed.columns], "__buckets").mapInArrow(_packed(text), "bucket long, least long, packed string, places array<long>")
    judged = _sorted(packed, "bucket", "least").mapInArrow(_judged, "route long, rid long, span long, doc long, window string")
    settled = _sorted(judged, "route", "window", "doc").mapInArrow(_settled, "rid long, span long")
    return settled.repartition("rid").groupBy(F.col("rid").alias("__rid")).agg(F.collect_list("span").alias("__spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept (the words that stay, joined by one space), n_words and n_removed; columns of these names are replaced.

    A word goes if a window of WIDTH words covers it whose words also start in a document with a smaller key. Windows are
    those of the input, so what one document loses has no effect on another. A null or empty text has no words. A null
    key counts as larger than all others, so of two such documents neither is the earlier one. Rows with equal keys are
    documents of their own, none earlier than the other; equal rows get equal results. No rows give no rows. Spans find
    their row by a 64-bit hash of key and text.
    """
    source = without(docs, "kept", "n_words", "n_removed")
    number: Column = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    columns = [F.col(f"`{c}`") for c in source.columns]
    keyed = source.select(*columns, F.xxhash64(number, F.coalesce(text, F.lit(""))).alias("__rid"), number.alias("__doc"))
    joined = keyed.join(spans(keyed, text), "__rid", "left").select(*columns, "__rid", "__doc", "__spans")
    schema = extended(source, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()))
    return joined.mapInArrow(_cleaned(text), schema)
