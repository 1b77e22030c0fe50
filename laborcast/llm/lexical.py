"""Ranked lexical search: Block-Max MaxScore over shards of compressed posting lists.

:func:`build_index` cuts the documents into shards and writes, per shard and term, a posting list in blocks of BLOCK
documents: gaps and counts in one, two or four bytes a value, and per block its last document and its highest impact.
:func:`search` brings the lists of the asked terms together shard by shard. Terms are ordered by the highest score they can
add; those that together can't reach the k-th best score so far are non-essential. Only essential lists propose documents.
A proposed document is dropped by the bounds of the non-essential lists, then by the highest impact of the very block it
would be in, and only what is left makes a block be decompressed. The best documents of all shards are then merged.

A term's impact in a document is ``(SCALE * tf) div (1000 * tf + 12 * m)``, where ``m = 75 + (25 * n * N) div L`` with n terms
in the document, N documents with terms and L terms in all of these: BM25 with k1 = 1.2 and b = 0.25 in whole numbers.
"""
from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import checkpoint_folder
from .wordbytes import parts, word_spans

SCALE = 1_000_000_000
#: Postings of a block, documents scored at once, and bytes of text of a shard; none has an effect on results.
BLOCK, SPAN, SHARD = 128, 2048, 16 << 20
#: Queries are searched in groups of about this many rows and characters; the terms of a group are broadcast up to BROADCAST_TERMS.
QUERY_ROWS, QUERY_CHARS, BROADCAST_TERMS = 1000, 1_000_000, 100_000
_HEAD = np.dtype([("last", "<i4"), ("bound", "<i4"), ("at", "<i4"), ("gap_bytes", "u1"), ("count_bytes", "u1"), ("n", "<u2")])


@dataclass(frozen=True)
class Index:
    """A written index: the folder, the number of documents with terms and of their terms, and the type of the documents' key."""

    path: str
    n_docs: int
    n_terms: int
    key_type: T.DataType


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order: runs of digits, letters and characters above 127, A-Z lower-cased."""
    data, start, size, _ = word_spans(pa.array([text], pa.string()))
    return [data[s:s + n].tobytes() for s, n in zip(start.tolist(), size.tolist())]


def _row_type(key_type: T.DataType) -> T.StructType:
    """A row of the index: the list of a term in a shard; ``head`` has its blocks' heads, ``body`` the blocks. See the empty term below."""
    return (T.StructType().add("shard", T.StringType()).add("term", T.BinaryType()).add("n", T.LongType()).add("bound", T.LongType())
            .add("head", T.BinaryType()).add("body", T.BinaryType()).add("keys", T.ArrayType(key_type)))


def _totals(docs: DataFrame) -> tuple[int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            column = batch.column(0)
            for rows in parts(column):
                words = word_spans(column[rows])[3]
                n_docs, n_terms = n_docs + int((words > 0).sum()), n_terms + int(words.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])

    row = docs.select("text").mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return row[0] or 0, row[1] or 0


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (1000 * tf + 12 * m)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Pieces of an array of bytes as a binary column, without a copy a piece."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)])


def _packed(values: np.ndarray, width: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
    """Writes every value to ``out`` at its place in its width, lowest byte first."""
    for byte in range(4):
        wide = np.flatnonzero(width > byte)
        if len(wide):
            out[place[wide] + byte] = (values[wide] >> (8 * byte)) & 255


def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def posting_lists(column: pa.Array, n_docs: int, n_terms: int) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(term, postings, highest impact, block heads, blocks) of every term of a shard, and m of each of its texts."""
    data, start, size, words = word_spans(column)
    m = 75 + np.array([25 * n * n_docs // n_terms for n in words.tolist()], dtype=np.int64)
    coded = _binary(data[data != 0], np.concatenate([[0], np.cumsum(size)])).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    each, tf = np.unique(codes * len(words) + np.repeat(np.arange(len(words)), words), return_counts=True)
    code, doc = each // len(words), each % len(words)
    impact = _impact(tf, m[doc])
    lists = np.flatnonzero(np.diff(code, prepend=-1))
    n = np.diff(lists, append=len(code))
    within = np.arange(len(code)) - np.repeat(lists, n)
    blocks = np.flatnonzero(within % BLOCK == 0)
    in_block = np.diff(blocks, append=len(code))
    gap = np.diff(doc, prepend=0)
    gap[lists] = doc[lists] + 1  # gaps count from the document before the first
    gap_bytes, count_bytes = _widths(np.maximum.reduceat(gap, blocks)), _widths(np.maximum.reduceat(tf, blocks))
    sizes = in_block * (gap_bytes + count_bytes)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    owner = np.repeat(np.arange(len(blocks)), in_block)
    rank = np.arange(len(code)) - blocks[owner]
    head_place = (ends - sizes)[owner]
    _packed(gap, gap_bytes[owner], head_place + rank * gap_bytes[owner], out)
    _packed(tf, count_bytes[owner], head_place + in_block[owner] * gap_bytes[owner] + rank * count_bytes[owner], out)
    first_block = np.searchsorted(blocks, lists)
    list_at = np.append((ends - sizes)[first_block], ends[-1])
    heads = np.zeros(len(blocks), dtype=_HEAD)
    heads["last"], heads["bound"], heads["n"] = doc[blocks + in_block - 1], np.maximum.reduceat(impact, blocks), in_block
    heads["gap_bytes"], heads["count_bytes"] = gap_bytes, count_bytes
    heads["at"] = (ends - sizes) - np.repeat(list_at[:-1], np.diff(first_block, append=len(blocks)))
    head_at = np.append(first_block, len(blocks)) * _HEAD.itemsize
    terms = coded.dictionary.take(pa.array(code[lists]))
    return terms, n, np.maximum.reduceat(impact, lists), _binary(heads.view(np.uint8), head_at), _binary(out, list_at), m


def build_index(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", shard: int = SHARD) -> Index:
    """Writes the posting lists of all terms of whole texts to ``folder`` (new, in the checkpoint folder unless given) as Parquet.

    Texts are read twice: for the totals that impacts need, and for the lists. Nothing is shuffled: a shard is a run of rows
    of one task with about ``shard`` bytes of text, one text at least, which bounds memory. Null texts have no terms. Repeated
    rows are documents of their own. An empty table gives an empty index. Other columns of ``docs`` are not read.
    """
    named = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"))
    key_type = named.schema["key"].dataType
    n_docs, n_terms = _totals(named)
    schema = _row_type(key_type)
    key_list = pa.list_(to_arrow_type(key_type))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in parts(batch.column(0), shard):
                texts, keys = batch.column(0)[rows], batch.column(1)[rows]
                if not len(word_spans(texts)[1]):
                    continue
                terms, n, bound, heads, bodies, m = posting_lists(texts, n_docs, n_terms)
                name, number = f"{task}-{number}", number + 1
                # the documents of the shard are the row of the empty term: m as its body, and the keys
                yield pa.RecordBatch.from_arrays([
                    pa.array([name]), pa.array([b""], pa.binary()), pa.array([len(m)]), pa.array([0]), pa.array([b""], pa.binary()), pa.array([m.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(key_list)], names=schema.names)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(n)), terms.cast(pa.binary()), pa.array(n), pa.array(bound), heads.cast(pa.binary()), bodies.cast(pa.binary()),
                    pa.nulls(len(n), key_list)], names=schema.names)

    path = folder or f"{checkpoint_folder(docs.sparkSession)}/lexical-{uuid.uuid4().hex}"
    named.mapInArrow(index, schema).write.parquet(path)
    return Index(path, n_docs, n_terms, key_type)


class Postings:
    """One list of a shard; blocks are decompressed when first asked for."""

    def __init__(self, head: bytes, body: bytes, m: np.ndarray):
        self.head, self.body, self.m = np.frombuffer(head, dtype=_HEAD), body, m
        self.last, self.bounds = self.head["last"].astype(np.int64), self.head["bound"].astype(np.int64)
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of block i."""
        if i not in self.read:
            h = self.head[i]
            n, at, wide, narrow = int(h["n"]), int(h["at"]), int(h["gap_bytes"]), int(h["count_bytes"])
            gaps = np.frombuffer(self.body, dtype=f"<u{wide}", count=n, offset=at).astype(np.int64)
            tf = np.frombuffer(self.body, dtype=f"<u{narrow}", count=n, offset=at + n * wide)
            docs = np.cumsum(gaps) + (self.last[i - 1] if i else -1)
            self.read[i] = docs, _impact(tf, self.m[docs])
        return self.read[i]


def best(lists: list[tuple[int, int, Postings]], n_docs: int, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k highest scores above 0, equal scores by ``order``; ``lists`` has (weight, highest impact, postings)."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[1])
    reach = np.cumsum([w * bound for w, bound, _ in lists])  # what the first lists can add together
    top, scores, least = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1
    for low in range(0, n_docs, SPAN):
        first = int(np.searchsorted(reach, least))  # the lists before this are non-essential: together they stay below the least score
        if first == len(lists):
            break
        high = min(n_docs, low + SPAN)
        sums, proposed = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=bool)
        for weight, _, postings in lists[first:]:
            for i in range(int(np.searchsorted(postings.last, low)), len(postings.last)):
                docs, impacts = postings.block(i)
                if docs[0] >= high:
                    break
                a, b = np.searchsorted(docs, (low, high))
                sums[docs[a:b] - low] += weight * impacts[a:b]
                proposed[docs[a:b] - low] = True
        docs = np.flatnonzero(proposed) + low
        found = sums[docs - low]
        for j in range(first - 1, -1, -1):
            weight, _, postings = lists[j]
            able = found + reach[j] >= least
            docs, found = docs[able], found[able]
            if not len(docs):
                break
            block = np.searchsorted(postings.last, docs)
            inside = block < len(postings.last)
            most = np.where(inside, postings.bounds[np.minimum(block, len(postings.last) - 1)], 0)
            able = found + weight * most + (reach[j - 1] if j else 0) >= least  # by the block's highest impact
            docs, found, block, inside = docs[able], found[able], block[able], inside[able]
            for i in np.unique(block[inside]).tolist():
                here = np.flatnonzero(block == i)
                listed, impacts = postings.block(i)
                at = np.searchsorted(listed, docs[here])  # below the length: the block's last document is not before these
                found[here] += np.where(listed[at] == docs[here], weight * impacts[at], 0)
        able = found >= least
        top, scores = np.concatenate([top, docs[able]]), np.concatenate([scores, found[able]])
        if len(top) > k:
            keep = np.lexsort((order[top], -scores))[:k]
            top, scores = top[keep], scores[keep]
        if len(top) == k:
            least = max(1, int(scores.min()))
    return top, scores


def _groups(queries: DataFrame) -> Iterator[list]:
    """The queries in groups by a hash, as collected rows; the number of groups grows with the rows and their texts."""
    rows, chars = queries.agg(F.count("*"), F.sum(F.length("text"))).first()
    groups = max(1, -(-rows // QUERY_ROWS), -(-(chars or 0) // QUERY_CHARS))
    for group in range(groups):
        yield queries.where(F.pmod(F.xxhash64("key", "text"), F.lit(groups)) == group).collect() if groups > 1 else queries.collect()


def _search(spark: SparkSession, index: Index, lists: DataFrame, queries: list, k: int, item_type: T.DataType) -> DataFrame:
    """(query, item, doc, score) of the k best of each shard for a group of queries."""
    asked = [(row["key"], Counter(terms_of(row["text"]))) for row in queries]
    terms = sorted({t for _, counts in asked for t in counts})
    wanted = spark.createDataFrame([(t,) for t in [b"", *terms]], "term binary")
    found = lists.join(F.broadcast(wanted) if len(terms) <= BROADCAST_TERMS else wanted, "term", "left_semi")
    having = {bytes(r["term"]): r["df"] for r in found.where(F.length("term") > 0).groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weights = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1))) for t, df in having.items()}
    plans = [(i, item, [(t, c * weights[t]) for t, c in counts.items() if t in weights]) for i, (item, counts) in enumerate(asked)]
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("item", item_type), T.StructField("doc", index.key_type), T.StructField("score", T.LongType())])
    item_arrow, doc_arrow = to_arrow_type(item_type), to_arrow_type(index.key_type)

    def in_shard(rows: pa.Table) -> pa.Table:
        held = {r["term"]: r for r in rows.to_pylist()}
        whole = held.pop(b"")
        m, keys = np.frombuffer(whole["body"], dtype=np.int64), whole["keys"]
        order = np.empty(len(keys), dtype=np.int64)
        order[sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]))] = np.arange(len(keys))
        postings = {t: Postings(r["head"], r["body"], m) for t, r in held.items()}
        number, items, docs, scores = [], [], [], []
        for i, item, plan in plans:
            top, found = best([(w, held[t]["bound"], postings[t]) for t, w in plan if t in held], len(keys), order, k)
            number += [i] * len(top)
            items += [item] * len(top)
            docs += [keys[d] for d in top.tolist()]
            scores += found.tolist()
        return pa.table([pa.array(number, pa.int64()), pa.array(items, item_arrow), pa.array(docs, doc_arrow), pa.array(scores, pa.int64())], names=schema.names)

    return found.groupBy("shard").applyInArrow(in_shard, schema)


def search(index: Index, queries: DataFrame, k: int = 20, text: str = "text", key: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """(``key``, rank, ``doc``, score): the k documents with the highest scores above 0 for each row of ``queries``.

    A score adds up, over the terms of the query with repeats, floor(1000 ln((2 N + 2) / (2 df + 1))) times the term's impact.
    Equal scores come by rising key, null first. Queries without known terms (null or empty ones) have no rows; repeated
    query rows are queries of their own, and repeated documents each have a rank. No query or an empty index gives no rows.

    All documents are searched. Queries come to the driver in groups of a bounded size, for each of which the lists of its
    terms are read; a shard sends k rows a query, which are cut to k a task before they meet.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    item_type = asked.schema["key"].dataType
    lists = spark.read.schema(_row_type(index.key_type)).parquet(index.path)
    out = None
    for rows in _groups(asked) if index.n_docs else []:
        found = _search(spark, index, lists, rows, k, item_type)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc()))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("item").alias(key), "rank", F.col("doc").alias(doc), "score")
        out = ranked if out is None else out.unionAll(ranked)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(key, item_type), T.StructField("rank", T.IntegerType()), T.StructField(doc, index.key_type), T.StructField("score", T.LongType())]))
    return out
