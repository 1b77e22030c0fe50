"""CRC-32 of many spans of one byte array at once.

Without its start value a CRC is linear: it is the XOR of what each byte adds, and that depends only on the byte and its
distance from the end of the span. So the contributions of all bytes are one table lookup, and all spans one
``bitwise_xor.reduceat``; the start value adds a constant that depends on the length alone. Spans longer than BLOCK are
reduced block by block, and the blocks are folded in order: a state moves over BLOCK bytes by four lookups.
"""
from __future__ import annotations

import numpy as np

#: Bytes of a block: the longest distance in the position table.
BLOCK = 64
_POLYNOMIAL, _ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)
#: Bytes looked up at once; it bounds memory and has no effect on results.
_CHUNK = 4 << 20


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def _past_zero(state: np.ndarray) -> np.ndarray:
    """States after one more byte of zero."""
    return _TABLE[state & 255] ^ (state >> 8)


def _position_table() -> np.ndarray:
    rows = [_TABLE]
    for _ in range(BLOCK - 1):
        rows.append(_past_zero(rows[-1]))
    return np.concatenate(rows)


def _length_constants() -> np.ndarray:
    out = np.empty(BLOCK + 1, dtype=np.uint32)
    out[0] = _ONES
    for n in range(BLOCK):
        out[n + 1] = _past_zero(out[n:n + 1])[0]
    return out


def _block_tables() -> np.ndarray:
    """Per byte of a state, what it becomes BLOCK bytes later."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(BLOCK):
        states = _past_zero(states)
    return states


_POSITION, _START, _MOVE = _position_table(), _length_constants(), _block_tables()


def _past_block(state: np.ndarray) -> np.ndarray:
    return _MOVE[0][state & 255] ^ _MOVE[1][(state >> 8) & 255] ^ _MOVE[2][(state >> 16) & 255] ^ _MOVE[3][state >> 24]


def _raw(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The linear part of spans of 1 to BLOCK bytes."""
    out = np.empty(len(start), dtype=np.uint32)
    ends = np.cumsum(length)
    first = 0
    while first < len(start):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _CHUNK)))
        here, size = start[first:last], length[first:last]
        heads = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        distance = np.repeat(heads + size - 1, size) - at
        values = _POSITION[(distance << 8) + data[np.repeat(here - heads, size) + at]]
        out[first:last] = np.bitwise_xor.reduceat(values, heads)
        first = last
    return out


def crc32_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of ``data[start:start + length]`` for every span (they may overlap, in any order; empty ones give 0).

    ``data`` is an array of bytes. Memory beyond the spans themselves is bounded by _CHUNK.
    """
    start, length = np.asarray(start, dtype=np.int64), np.asarray(length, dtype=np.int64)
    out = np.zeros(len(start), dtype=np.uint32)
    full = np.flatnonzero(length > 0)
    if not len(full):
        return out
    s, n = start[full], length[full]
    blocks = (n + BLOCK - 1) // BLOCK
    head = n - BLOCK * (blocks - 1)  # the first block takes what is over, all others are whole
    state = _START[head] ^ _raw(data, s, head)
    long = np.flatnonzero(blocks > 1)
    done = 1
    while len(long):
        at = s[long] + head[long] + BLOCK * (done - 1)
        state[long] = _past_block(state[long]) ^ _raw(data, at, np.full(len(long), BLOCK))
        done += 1
        long = long[blocks[long] > done]
    out[full] = state ^ _ONES
    return out
