"""Words of whole string columns as spans of one byte array, without a string a word."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What a byte of a text is turned into: A-Z into a-z; 0 for what separates words, which are digits, letters and all bytes above 127.
WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 0 for b in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the place where each text starts, with the end; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def parts(column: pa.Array, most: int = 8 << 20) -> Iterator[slice]:
    """Consecutive rows whose texts come to about ``most`` bytes, one row at least; they bound memory."""
    upto = text_bytes(column)[1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + most)) - 1)
        yield slice(first, last)
        first = last


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start of every word, bytes of every word, words of each text); a word ends with its text."""
    data, offsets = text_bytes(column)
    data = WORD[data]
    inside = data != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return data, start, end - start, np.diff(np.searchsorted(start, offsets))
