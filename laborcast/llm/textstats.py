"""Counts over one text, shared by the quality operators. Words are runs of anything but space and the controls 9 to 13."""
from __future__ import annotations

import numpy as np


def ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's number among the distinct ones, and how many there are."""
    distinct, number = np.unique(values, return_inverse=True)
    return number.astype(np.int64), len(distinct)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more in the text, the first included.

    Most texts repeat no window: if the windows' hashes all differ, so do the windows. Otherwise windows are numbered by
    doubling, so that equal numbers mean equal words.
    """
    if len(words) <= width:
        return 0
    h, n = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), len(words) - width + 1
    windows = h[:n].copy()
    for j in range(1, width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    windows.sort()
    if (windows[1:] != windows[:-1]).all():
        return 0
    table = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(table) == len(words):
        return 0
    single = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    names, count, have = single, len(table), 1
    while have < width:
        step = min(have, width - have)
        names, count = ranks(names[:len(names) - step] * np.int64(count) + names[step:])
        have += step
        if count == len(names):
            return 0
    again = np.bincount(names, minlength=count)[names] >= 2
    change = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def line_counts(text: str) -> tuple[int, int]:
    """(lines with a word, those among them that equal an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))
