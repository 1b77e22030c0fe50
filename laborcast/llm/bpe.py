"""Byte-level BPE encoding and decoding with a given vocabulary.

Encoding backtracks: at each position the longest token that matches (from an Aho-Corasick automaton over the
vocabulary) is tried against the token before it, and kept if the merges could have left this pair side by side.
If not, its longest prefix that is a token is tried, and if none fits, the token before is taken back. A position
that failed once is never tried again, so the work is linear in the text and the result is that of the merges
applied in order. Decoding gathers each token's bytes from one buffer by an offset table.
"""
from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import extended, slices, with_columns, without

#: Fixed value: the split before the merges in byte-level vocabularies of this kind.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose encoding a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: Token pairs whose compatibility a worker remembers.
REMEMBERED_PAIRS = 1_000_000
#: Texts above this many characters are split piece by piece instead of into one list.
LONG = 1 << 20
_CHUNK = 1 << 18


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, and the byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of one vocabulary file.

    Inside, a token is a number: single bytes first, then merges in their order, so a lower number was merged earlier.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_bytes = lambda text: bytes(letters[c] for c in text)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self._piece = regex.compile(PIECES)
        names = [letter for letter in sorted(letters, key=letters.get)]
        number = {name: i for i, name in enumerate(names)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in merges:
            left, right = merge if not isinstance(merge, str) else merge.split(" ")
            pair = (number[left], number[right])
            if left + right in number or pair in self.merged:
                continue
            number[left + right] = self.merged[pair] = len(names)
            names.append(left + right)
            self.parts.append(pair)
        self.bytes = [to_bytes(n) for n in names]
        self.outer = [ids[n] for n in names]
        self.length = [len(b) for b in self.bytes]
        reachable = [True] * len(names)
        for token in range(256, len(names)):
            left, right = self.parts[token]
            reachable[token] = reachable[left] and reachable[right] and self._fits(left, right, token)
        known = {b: i for i, b in enumerate(self.bytes) if reachable[i]}
        self.shorter = [next((known[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in known), -1) for b in self.bytes]
        self._matches = ahocorasick.Automaton()
        for data, token in known.items():
            self._matches.add_word(data.decode("latin-1"), token)
        self._matches.make_automaton()
        self._compatible: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        # The offset table of the outer ids.
        size = max([*ids.values(), *self.specials.values()]) + 1
        by_id: list[bytes] = [b""] * size
        for text, i in ids.items():
            by_id[i] = to_bytes(text) if all(c in letters for c in text) else text.encode()
        for text, i in self.specials.items():
            by_id[i] = text.encode()
        self._sizes = np.array([len(b) for b in by_id], dtype=np.int64)
        self._offsets = np.concatenate([[0], np.cumsum(self._sizes)[:-1]])
        self._buffer = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def _fits(self, left: int, right: int, limit: int = 1 << 62) -> bool:
        """Whether no merge earlier than those inside the two tokens would have joined their facing ends."""
        merged, parts = self.merged, self.parts
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two tokens; what now faces must have stayed apart until that merge.
            if left > right:  # of two equal ones the right one was made later
                limit, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def compatible(self, left: int, right: int) -> bool:
        """The pair table, filled as pairs are met."""
        key = left << 20 | right
        found = self._compatible.get(key)
        if found is None:
            if len(self._compatible) >= REMEMBERED_PAIRS:
                self._compatible.clear()
            found = self._compatible[key] = self._fits(left, right)
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of text."""
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        longest = [-1] * len(data)
        for end, token in self._matches.iter(data):
            longest[end - self.length[token] + 1] = token  # later ends are longer
        tokens: list[int] = []
        failed = bytearray(len(data) + 1)
        length, compatible, at = self.length, self.compatible, 0
        token = longest[0] if data else -1
        while at < len(data):
            end = at + length[token]
            if not failed[end] and (not tokens or compatible(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at] if at < len(data) else -1
                continue
            token = self.shorter[token]
            if token < 0:
                failed[at] = 1
                token = tokens.pop()
                at -= length[token]
                token = self._next(token, at, failed, tokens)
                while token < 0:
                    failed[at] = 1
                    token = tokens.pop()
                    at -= length[token]
                    token = self._next(token, at, failed, tokens)
        return tuple(self.outer[t] for t in tokens)

    def _next(self, token: int, at: int, failed: bytearray, tokens: list[int]) -> int:
        """The next shorter token at ``at`` whose end has not failed and which fits the one before, or -1."""
        token = self.shorter[token]
        while token >= 0 and (failed[at + self.length[token]] or tokens and not self.compatible(tokens[-1], token)):
            token = self.shorter[token]
        return token

    def _known(self, piece: str) -> tuple[int, ...]:
        found = self._pieces.get(piece)
        if found is None:
            if len(self._pieces) >= REMEMBERED:
                self._pieces.clear()
            found = self.encode_piece(piece)
            if len(piece) <= 64:
                self._pieces[piece] = found
        return found

    def _ordinary(self, text: str, ids: array) -> None:
        if len(text) > LONG:
            ids.extend(chain.from_iterable(self._known(m.group()) for m in self._piece.finditer(text)))
        else:
            ids.extend(chain.from_iterable(map(self._known, self._piece.findall(text))))

    def encode_into(self, text: str, ids: array) -> None:
        """Append the ids of a text; the special tokens' own strings become their ids."""
        if self._special is None or not any(s in text for s in self.specials):
            self._ordinary(text, ids)
            return
        for part in self._special.split(text):
            if part in self.specials:
                ids.append(self.specials[part])
            elif part:
                self._ordinary(part, ids)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        parts = []
        for start in range(0, len(ids), _CHUNK):
            chunk = ids[start:start + _CHUNK]
            sizes = self._sizes[chunk]
            before = np.cumsum(sizes) - sizes
            index = np.repeat(self._offsets[chunk] - before, sizes) + np.arange(int(sizes.sum()))
            parts.append(self._buffer[index].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The tables of a file, built once in each worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``docs`` with an array column of token ids and, unless ``decoded`` is None, the text decoded from them again.

    ``path`` names a byte-level BPE file that every executor can read. A null or empty text has no ids and decodes to
    the empty text. Columns of ``docs`` that have the names of the new ones are replaced; all others stay, repeated rows
    and nulls included. Texts of any length are encoded whole. No rows give no rows. There is no shuffle.
    """
    added = [ids, *([decoded] if decoded else [])]
    if text in added:
        raise ValueError("the new columns can't replace the text")
    source = without(docs, *added)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary(path)
        for part, texts in slices(batches, text, 4 << 20):
            flat, ends = array("i"), [0]
            for t in texts:
                tables.encode_into(t, flat)
                ends.append(len(flat))
            values = np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32)
            new = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))}
            if decoded:
                new[decoded] = pa.array([tables.decode(values[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
            yield with_columns(part, **new)

    return source.mapInArrow(run, extended(source, *fields))
