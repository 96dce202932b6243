"""Distinct word shingles of many texts at once, as 64-bit hashes.

A text is lower-cased in A-Z; its words are maximal runs of bytes other than ASCII white space.  Its set
holds its distinct runs of ``SIZE`` words; with fewer words, the whole sequence as one; without words it is
empty.
"""

from __future__ import annotations

import numpy as np

from . import textbytes as tb

SIZE = 5
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, all in one array, and where each row starts in it."""
    data = tb.LOWER[data]
    starts, ends, rows = tb.word_spans(data, offsets)
    words = tb.span_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    full = len(words) - size + 1
    h = np.zeros(max(full, 0), np.uint64)
    for k in range(size):
        h = tb.mix(h * _STEP + words[k : k + max(full, 0)])
    inside = rows[:full] == rows[size - 1 :] if full > 0 else np.zeros(0, bool)
    h, where = h[inside] if full > 0 else h, rows[: max(full, 0)][inside]
    counts = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            whole[more] = tb.mix(whole[more] * _STEP + words[first[more] + k])
        h, where = np.concatenate((h, tb.mix(whole + counts[short].astype(np.uint64)))), np.concatenate((where, short))
    order = np.lexsort((h, where))
    h, where = h[order], where[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (where[1:] != where[:-1])
    h, where = h[new], where[new]
    return h, np.searchsorted(where, np.arange(n_rows + 1))
