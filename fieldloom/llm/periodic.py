"""Operator 13: periodic runs of words, by the runs theorem.

A run is a maximal stretch whose words repeat with a smallest period q at least twice over.  Every run has a root, a
stretch of q words that is a Lyndon word under one of two orders of the alphabet (the plain one or its reverse), and is
the longest Lyndon word that starts at its place.  So of each place two candidates suffice: the longest Lyndon word
under either order, which ends at the next smaller value of the inverse suffix array.  Each candidate is extended to
both sides as far as words q apart agree: a longest common prefix of two suffixes, and, over the reversed words, of two
prefixes, both the smallest of a range of the LCP array, which a sparse table gives in one step.

Stretches are put one after another, each ended by a symbol below all others, and go through suffix arrays together.
Before that, words that can be in no run with exponent ``EXPONENT`` are cut out: a run repeats each of its words
that often, so a word that occurs fewer times in its stretch is in none, nor can it extend one (it would equal a word of
the run).  That is exact, whatever the text, and what is left, mostly repetition, is what suffix arrays are built for;
``thin=False`` leaves it out.

Words are told apart by 64-bit hashes.  Documents are worked on whole, where they are, without a shuffle; a task's
memory is bounded by ``SLICE`` bytes of text or the longest document.

Edge cases: null and empty texts have no words and no runs; documents without an id are read as they stand (their
words are not rearranged); repeated rows are documents each; extra columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .suffixes import suffix_array

#: A run has at least this many words, and this many times its period.
SHORTEST, EXPONENT = 6, 4
#: Bytes of text that are worked on together.
SLICE = 1 << 22
#: Rounds of cutting out rare words; more would cost time and change nothing.
ROUNDS = 8


def lcp_array(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How many symbols each suffix in ``order`` has in common with the one before, found in text order."""
    symbols, before = text.tolist(), np.empty(len(text), np.int64)
    before[order[1:]], before[order[:1]] = order[:-1], -1
    common, n, h = [0] * len(text), len(text), 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        top = n - max(i, j)
        while h < top and symbols[i + h] == symbols[j + h]:
            h += 1
        common[i] = h
        h = h - 1 if h else 0
    return np.array(common, np.int64)[order]


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one to the right with a smaller value; the length where there is none."""
    numbers, out, open_places = values.tolist(), [len(values)] * len(values), []
    for i, v in enumerate(numbers):
        while open_places and numbers[open_places[-1]] > v:
            out[open_places.pop()] = i
        open_places.append(i)
    return np.array(out, np.int64)


class CommonPrefixes:
    """Longest common prefixes of two suffixes of a text, in one step each."""

    def __init__(self, text: np.ndarray):
        self.order = suffix_array(text)
        self.rank = np.empty(len(text), np.int64)
        self.rank[self.order] = np.arange(len(text))
        self.table = [lcp_array(text, self.order, self.rank).astype(np.int32)]
        while (half := 1 << (len(self.table) - 1)) * 2 <= len(text):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different places, how many symbols the suffixes there share."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        out, level = np.zeros(len(a), np.int64), np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] + 1 - (1 << int(k))])
        return out


def find_runs(text: np.ndarray, shortest: int = 2, exponent: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a text of positive symbols, in which zeros end stretches.

    Runs never hold a zero.  The text must end with one.  Runs come by start, then period.
    """
    n = len(text)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    forward, backward = CommonPrefixes(text), CommonPrefixes(text[::-1])
    top = int(text.max()) + 1
    turned = np.empty(n, np.int64)
    turned[suffix_array(np.where(text > 0, top - text, 0))] = np.arange(n)
    # what ends a stretch is smaller than all symbols of it, under both orders, so no Lyndon word goes beyond
    begin, end = np.concatenate([np.stack((np.arange(n), next_smaller(rank))) for rank in (forward.rank, turned)], 1)
    inside = (text[begin] > 0) & (end < n)
    begin, end = begin[inside], end[inside]
    # agreement of the suffixes at a root's two ends, and of the prefixes before them: neither crosses a zero, which one of
    # the two meets while the other is at a symbol; the prefix before place 0 is empty
    ahead = forward.of(begin, end)
    behind, some = np.zeros(len(begin), np.int64), np.flatnonzero(begin > 0)
    behind[some] = backward.of(n - begin[some], n - end[some])
    start = begin - behind
    length, period = end + ahead - start, end - begin
    found = (length >= 2 * period) & (length >= exponent * period) & (length >= shortest)
    runs = np.unique(np.stack((start[found], period[found], length[found])), axis=1)
    return runs[0], runs[2], runs[1]


def candidate_stretches(words: np.ndarray, owner: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """Stretches (first, end) of consecutive words of one owner outside which no run can be."""
    places = np.arange(len(words))
    stretch = owner.astype(np.int64)
    for _ in range(ROUNDS):
        keys = tb.mix(words[places] ^ tb.mix(stretch.astype(np.uint64) + np.uint64(1)))
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        kept = places[counts[which] >= exponent]
        breaks = np.flatnonzero((np.diff(kept, prepend=-2) != 1) | (np.diff(owner[kept], prepend=-1) != 0))
        sizes = np.diff(np.append(breaks, len(kept)))
        long = np.repeat(sizes >= shortest, sizes)
        fewer = len(places) - int(long.sum())
        stretch, places = np.repeat(np.arange(len(sizes)), sizes)[long], kept[long]
        if not fewer or not len(places):
            break
    if not len(places):
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero((np.diff(places, prepend=-2) != 1) | (np.diff(owner[places], prepend=-1) != 0))
    last = np.append(first[1:], len(places)) - 1
    return np.stack((places[first], places[last] + 1), 1)


def runs_of(words: np.ndarray, owner: np.ndarray, thin: bool = True) -> np.ndarray:
    """Rows (first word, length, period) of the runs of word hashes, each within one owner; words are numbered over all."""
    if thin:
        stretches = candidate_stretches(words, owner)
    else:
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        stretches = np.stack((first, np.append(first[1:], len(owner))), 1)
    if not len(stretches):
        return np.zeros((0, 3), np.int64)
    sizes = stretches[:, 1] - stretches[:, 0]
    put = np.cumsum(sizes + 1) - sizes - 1  # where a stretch starts in the text; a zero follows each
    inside = np.repeat(stretches[:, 0] - put, sizes) + (at := np.repeat(put - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()))
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    text[at] = np.unique(words[inside], return_inverse=True)[1] + 1
    start, length, period = find_runs(text, SHORTEST, EXPONENT)
    which = np.searchsorted(put, start, "right") - 1
    return np.stack((start - put[which] + stretches[which, 0], length, period), 1)


def rearranged(counts: np.ndarray, codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which original word stands at each place: every tenth code makes the end of a document periodic.

    ``counts`` are documents' words, ``codes`` their numbers, valid where ``known``.
    """
    out = np.arange(int(counts.sum()))
    first = np.cumsum(counts) - counts
    for d in np.flatnonzero(known & (codes % 10 == 0) & (counts > 0)).tolist():
        n, g = int(counts[d]), int(codes[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[first[d] + a : first[d] + n] = first[d] + a + np.arange(n - a) % p
    return out


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by single spaces, for groups of words that begin at ``first`` (one more): bytes and offsets."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + step] = data[np.repeat(starts, sizes) + step]
    return out, np.append(to, len(out))[first]


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "array<struct<start: long, length: long, period: long>>"


def digest(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, known: np.ndarray, thin: bool = True) -> list[tuple]:
    """For each row of bytes: its runs (list of start, length, period) and the digest of what is left once they collapse."""
    starts, ends, row = tb.word_spans(data, offsets)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    source = rearranged(counts, codes, known)
    starts, ends = starts[source], ends[source]
    runs = runs_of(tb.span_hashes(data, starts, ends), row, thin)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    gone = np.zeros(len(row) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    bounds = np.searchsorted(row[left], np.arange(len(offsets)))
    text, at = _joined(data, starts[left], ends[left], bounds)
    first = np.cumsum(counts) - counts
    of = row[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    cuts = np.searchsorted(of, np.arange(len(offsets)))
    out = []
    for d in range(len(offsets) - 1):
        own = runs[cuts[d] : cuts[d + 1]] - np.array([first[d], 0, 0])
        out.append((own.tolist(), hashlib.sha256(text[at[d] : max(at[d], at[d + 1] - 1)]).hexdigest()))
    return out


def periodic_runs(docs: DataFrame, code: str | None = None) -> DataFrame:
    """(doc_id, runs, collapsed_sha256) of each document; ``code`` names a column whose numbers rearrange words (see ``rearranged``)."""
    number = F.col(code).cast("long") if code else F.lit(None).cast("long")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column(1))
            codes, known = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for low, high in tb.slices(offsets, SLICE):
                found = digest(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], codes[low:high], known[low:high])
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own, _ in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), runs, pa.array([s for _, s in found], pa.string())], names=["doc_id", "runs", "collapsed_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), number.alias("code")).mapInArrow(work, schema)


def strongest(runs: DataFrame) -> DataFrame:
    """Each document's number of runs, the one with the greatest exponent, and a digest of all, from ``periodic_runs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RESULT.split(", ")]
        for batch in batches:
            rows = []
            for own in batch.column(1).to_pylist():
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in own)
                best = min(own, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if own else None
                most = [best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]] if best else [None] * 4
                rows.append((len(own), *most, hashlib.sha256(listed.encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            arrays = [pa.array(columns[k], pa.int64()) for k in range(5)] + [pa.array(columns[5], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(2)], names=names)

    return runs.mapInArrow(work, RESULT)


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("code", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return strongest(periodic_runs(docs, "code"))
