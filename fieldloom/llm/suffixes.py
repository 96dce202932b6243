"""Suffix arrays by induced sorting, in vector steps, and permuted common prefixes.

Suffixes are L (greater than the next one) or S; S suffixes after an L are leftmost-S, and sorting those
induces the order of all others in two linear passes.  They are sorted by the names of their substrings, which are
told apart as packed integers (long ones by such passes too).  A pass takes each bucket (one first symbol) in one step:
the suffixes that were put there, and those inside the runs of that symbol that they end (ordered by their distance
from the run's end), put their predecessors into their buckets at once, in order.  So a run of millions of one
symbol costs no more than its length.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Alphabets beyond this have more buckets than vector steps pay for; (reduced) strings of so many names are induced suffix by suffix.
WIDE = 1024
#: Symbols that substrings are compared one by one, all at once; the few longer ones are compared whole.
STEPWISE = 64
#: Times that substrings are compared by as many symbols as go into 64 bits; if some are alike beyond, they are sorted by induction.
ROUNDS = 16
#: Suffixes whose common prefixes are computed at once.
AT_ONCE = 1 << 20


def _s_types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last symbol is smaller than all others and alone."""
    step = t[1:] - t[:-1]
    at = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step)))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[nearest] > 0, True)


def _put(order: np.ndarray, free: np.ndarray, t: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Appends suffixes to their buckets, in the order given, upwards (step 1) or downwards (-1)."""
    symbols = t[suffixes]
    by = np.argsort(symbols, kind="stable")
    symbols = symbols[by]
    first = np.flatnonzero(np.diff(symbols, prepend=-1))
    sizes = np.diff(np.append(first, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(first, sizes)
    order[free[symbols] + step * rank] = suffixes[by]
    free[symbols[first]] += step * sizes


def _with_runs(seeds: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a bucket, from those that end its runs: all of them, in order, and those that start a run."""
    length = runs[seeds]
    if length.max(initial=1) == 1:
        return seeds, seeds
    which = np.repeat(np.arange(len(seeds)), length)
    back = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
    by = np.argsort(back, kind="stable")
    every = (seeds[which] - back)[by]
    return every, every[(back == length[which] - 1)[by]]


def _induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, induced from the leftmost-S ones in the order given."""
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    starts = ends - counts
    used = np.flatnonzero(counts)
    order = np.full(len(t), -1, np.int64)
    symbols = t[leftmost]
    by = np.argsort(symbols, kind="stable")
    grouped, bounds = leftmost[by], np.searchsorted(symbols[by], np.arange(sigma + 1))
    # how many equal symbols end at each place
    index = np.arange(len(t), dtype=np.int32)
    runs = index - np.maximum.accumulate(np.where(np.diff(t, prepend=t[:1] + 1) != 0, index, np.int32(0))) + 1
    del index

    free = starts.copy()
    for c in used:
        now, heads = _with_runs(order[starts[c] : free[c]], runs)
        order[starts[c] : starts[c] + len(now)] = now
        free[c] = starts[c] + len(now)
        before = heads[heads > 0] - 1
        before = before[t[before] > c]
        if len(before):
            _put(order, free, t, before, 1)
        now = grouped[bounds[c] : bounds[c + 1]]
        if len(now):
            _put(order, free, t, now[now > 0] - 1, 1)
    l_ends = free

    free = ends - 1
    order[0] = len(t) - 1
    for c in used[::-1]:
        now, heads = _with_runs(order[free[c] + 1 : ends[c]][::-1], runs)
        order[ends[c] - len(now) : ends[c]] = now[::-1]
        free[c] = ends[c] - 1 - len(now)
        before = heads[heads > 0] - 1
        before = before[t[before] < c]
        if len(before):
            _put(order, free, t, before, -1)
        now = order[starts[c] : l_ends[c]][::-1]
        before = now[now > 0] - 1
        before = before[small[before]]
        if len(before):
            _put(order, free, t, before, -1)
    return order


def _numbers(values: np.ndarray) -> array:
    """Numbers below 2**31 as a Python array, which takes four bytes each and gives plain integers."""
    out = array("i")
    out.frombytes(values.astype(np.int32).tobytes())
    return out


def _induce_singly(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, sigma: int) -> np.ndarray:
    """The same as ``_induce``, one suffix at a time: for strings whose buckets hold few suffixes each."""
    ends = np.cumsum(np.bincount(t, minlength=sigma))
    start = np.full(len(t), -1, np.int64)
    symbols = t[leftmost]
    by = np.argsort(symbols, kind="stable")
    after = np.cumsum(np.bincount(symbols, minlength=sigma))
    start[ends[symbols[by]] - after[symbols[by]] + np.arange(len(by))] = leftmost[by]
    # the bucket of the suffix before, in the pass in which it is put; -1 for none, also for places still empty (-1)
    toward = lambda which: _numbers(np.concatenate(([-1], np.where(which, t[:-1], -1), [-1])))
    order, free, rising = _numbers(start), _numbers(np.append(0, ends[:-1])), toward(~small[:-1])
    for i in order:  # what stands further on is put there by the loop itself
        c = rising[i]
        if c >= 0:
            at = free[c]
            order[at] = i - 1
            free[c] = at + 1
    free, falling = _numbers(ends - 1), toward(small[:-1])
    for i in reversed(order):
        c = falling[i]
        if c >= 0:
            at = free[c]
            order[at] = i - 1
            free[c] = at - 1
    order[0] = len(order) - 1
    return np.frombuffer(order, np.int32).astype(np.int64)


def _equal_spans(t: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether t[a : a + length] and t[b : b + length] are equal, for each row."""
    same, left = np.ones(len(a), bool), np.arange(len(a))
    for k in range(min(int(lengths.max(initial=0)), STEPWISE)):
        left = left[(lengths[left] > k)]
        left = left[same[left]]
        if not len(left):
            break
        same[left] = t[a[left] + k] == t[b[left] + k]
    for k in left[same[left] & (lengths[left] > STEPWISE)].tolist():
        same[k] = np.array_equal(t[a[k] : a[k] + lengths[k]], t[b[k] : b[k] + lengths[k]])
    return same


def _by_substring(t: np.ndarray, leftmost: np.ndarray, lengths: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Leftmost-S suffixes in the order of their substrings, and which differ from the one before; None if long ones are alike.

    Substrings are packed into integers, as many symbols as go into 64 bits at a time; those that are alike so far go on.
    One that ends is greater than one that goes on: its last symbol is S, the other's L.
    """
    bits = int(sigma).bit_length()
    many, past = 64 // bits, np.int64((1 << bits) - 1)
    padded = np.append(t, np.zeros(many, t.dtype))

    def packed(rows: np.ndarray, done: int) -> np.ndarray:
        out, at, left = np.zeros(len(rows), np.uint64), leftmost[rows] + done, lengths[rows] - done
        at = np.where(left > 0, at, 0)
        for k in range(many):
            out = (out << np.uint64(bits)) | np.where(left > k, padded[at + k], past).astype(np.uint64)
        return out

    by = np.argsort(first := packed(np.arange(len(leftmost)), 0))
    first = first[by]
    new = np.append(True, first[1:] != first[:-1])
    places = np.arange(len(by))
    for done in range(many, many * ROUNDS + 1, many):
        alike = ~new[places]
        alike[:-1] |= ~new[places[1:]] & (places[1:] == places[:-1] + 1)
        places = places[alike]
        places = places[lengths[by[places]] >= done]
        if not len(places):
            return by, new
        rows, group = by[places], np.cumsum(new[places])
        key = packed(rows, done)
        order = np.lexsort((key, group))
        by[places], key = rows[order], key[order]
        new[places[1:]] |= key[1:] != key[:-1]
    return None


def _by_induction(t: np.ndarray, leftmost: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from an order of all suffixes that is induced from the leftmost-S ones, whatever the lengths."""
    number = np.full(len(t), -1, np.int64)
    number[leftmost] = np.arange(len(leftmost))
    by = number[order]
    by = by[by >= 0]
    a, b = by[:-1], by[1:]
    same = (lengths[a] == lengths[b]) & (lengths[a] > 1)
    same[same] = _equal_spans(t, leftmost[a[same]], leftmost[b[same]], lengths[a[same]])
    return by, np.append(True, ~same)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a string of small non-negative integers, in order; a prefix comes first."""
    if not len(t):
        return np.zeros(0, np.int64)
    sigma = int(t.max()) + 2
    induce, kind = (_induce_singly, np.int64) if sigma > WIDE else (_induce, np.int16)
    t = np.append(t.astype(kind) + kind(1), kind(0))
    small = _s_types(t)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # substrings run from one leftmost-S position to the next; equal ones get one name
    lengths = np.diff(np.append(leftmost, len(t) - 1)) + 1
    by, new = _by_substring(t, leftmost, lengths, sigma) or _by_induction(t, leftmost, lengths, induce(t, small, leftmost, sigma))
    del lengths
    names = np.zeros(len(leftmost), np.int64)
    names[by] = np.cumsum(new) - 1
    if names.max(initial=0) < len(leftmost) - 1:
        del by, new
        leftmost = leftmost[suffix_array(names)]
    else:
        leftmost = leftmost[by]
    return induce(t, small, leftmost, sigma)[1:]


def common_with_previous(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in ``order``, whether it and the one before have at least ``length`` bytes in common.

    Computed in text order (permuted), eight bytes at a time; all suffixes must have that many bytes.
    """
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]
    every = np.flatnonzero(before >= 0)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.ndarray((len(text),), "<u8", padded, strides=(1,))
    tail = np.uint64((1 << (8 * (length % 8))) - 1)
    reaches = np.zeros(len(text), bool)
    for low in range(0, len(every), AT_ONCE):
        at = every[low : low + AT_ONCE]
        for k in range(0, length, 8):
            mine, other = words[at + k], words[before[at] + k]
            same = (mine ^ other) & tail == 0 if k + 8 > length else mine == other
            at = at[same]
        reaches[at] = True
    return reaches[order]
