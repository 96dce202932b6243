"""Operator 2: best-fit packing of tokenized documents, large items matched in pairs.

Every document becomes its token ids and the end id 0, cut into pieces of at most ``capacity``
tokens.  Packing is decided on the histogram of piece lengths (at most ``capacity`` numbers, whatever
the corpus' size) and then applied to all pieces in parallel:

1. pieces above a third of the capacity, longest first, are matched greedily: each takes the longest
   other one that fits beside it, so a sequence holds two of them at most;
2. shorter pieces, longest first, go each to the smallest gap that holds it, or to a new sequence.

Pieces of equal length are interchangeable, so "the r-th piece of length n" finds its place by binary
search in the plan.  Ranks come from chunked counts: no task sorts all pieces of one length.

Edge cases: null and empty texts are the single id 0; an empty table packs into nothing; rows that
repeat are packed each by itself; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .ranks import chunk_count, running_total
from .storage import materialize

CAPACITY, END_ID = 2048, 0
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker keeps; beyond it starts afresh.
CACHE_WORDS = 1_000_000


class WordTokenizer:
    """Ids of whole texts, by way of the ids of their words.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are
    those of its words one after another.  Each distinct word (told apart by a 64-bit hash) is
    tokenized once; that is several times faster than tokenizing whole texts.  Literals of special tokens
    (none has white space) get the special ids, inside words too, as in a plain call for the whole text.
    """

    #: Stands alone between words that are tokenized in one call.
    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._encode(self.MARK)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has."""
        ids, counts = [], []
        for low in range(0, len(words), 4096):
            some = words[low : low + 4096]
            got = np.array(self._encode(f" {self.MARK} ".join(some)), np.uint32)
            marks = np.flatnonzero(got == self.mark)
            if len(marks) != len(some) - 1:  # a word has the mark itself
                each = [self._encode(w) for w in some]
                ids += [np.array(x, np.uint32) for x in each]
                counts.append(np.array([len(x) for x in each], np.int64))
                continue
            counts.append(np.diff(np.concatenate(([-1], marks, [len(got)]))) - 1)
            ids.append(np.delete(got, marks))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row ended by END_ID, and where each row starts."""
        starts, ends, rows = tb.word_spans(data, offsets)
        hashes, first, which = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(np.r_[self.hashes, np.uint64(0)][at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            if len(self.hashes) + len(new) > CACHE_WORDS:
                self._clear()
                new = np.arange(len(hashes))
            raw = data.tobytes()
            ids, counts = self._encode_words([raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in first[new]])
            put = np.searchsorted(self.hashes, hashes[new])
            self.first = np.insert(self.first, put, len(self.ids) + np.cumsum(counts) - counts)
            self.count = np.insert(self.count, put, counts)
            self.hashes = np.insert(self.hashes, put, hashes[new])
            self.ids = np.concatenate((self.ids, ids))
            at = np.searchsorted(self.hashes, hashes)
        word = at[which]
        counts = self.count[word]
        total = int(counts.sum())
        source = np.repeat(self.first[word] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        out = np.full(total + len(offsets) - 1, END_ID, np.uint32)
        out[np.arange(total) + np.repeat(rows, counts)] = self.ids[source]
        sizes = np.bincount(rows, weights=counts, minlength=len(offsets) - 1).astype(np.int64) + 1
        return out, np.concatenate(([0], np.cumsum(sizes)))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(name: str) -> WordTokenizer:
    """This worker's tokenizer of a vocabulary file; kept, for its words, between tasks."""
    if name not in _tokenizers:
        import public_tokenizers

        _tokenizers[name] = WordTokenizer(name if name.startswith("/") else public_tokenizers.path(name))
    return _tokenizers[name]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = TOKENIZER) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary)
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for low, high in tb.slices(offsets):
                ids, at = words.encode_rows(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                sizes = np.diff(at)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(high - low), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                raw, first = memoryview(ids.astype("<u4").view(np.uint8)), 4 * (at[row] + start)
                crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(first.tolist(), length.tolist())]
                columns = [doc_ids.slice(low, high - low).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for all pieces of a histogram of lengths, and the number of sequences.

    A place (length, first_rank, how_many, first_sequence, offset) puts the pieces of that length with ranks
    from first_rank into that many consecutive sequences, at that offset.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of sequences (first, how many)
    n_sequences = 0

    def put(length: int, many: int, sequence: int, offset: int) -> None:
        places.append((length, used[length], many, sequence, offset))
        used[length] += many
        left[length] -= many

    def leave(gap: int, first: int, many: int) -> None:
        runs = gaps[gap]
        if runs and runs[-1][0] + runs[-1][1] == first:
            first, many = runs[-1][0], runs.pop()[1] + many
        runs.append((first, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for other in large:
            if left[n] and other <= n and n + other <= capacity and left[other]:
                many = left[n] // 2 if other == n else min(left[n], left[other])
                if many:
                    put(n, many, n_sequences, 0)
                    put(other, many, n_sequences, n)
                    leave(capacity - n - other, n_sequences, many)
                    n_sequences += many
        if left[n]:
            many = left[n]
            put(n, many, n_sequences, 0)
            leave(capacity - n, n_sequences, many)
            n_sequences += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g, runs in gaps.items() if g >= n and runs), default=None)
            if gap is None:
                fit = capacity // n
                many = max(1, left[n] // fit)
                leave(capacity, n_sequences, many)
                n_sequences += many
                continue
            first, many = gaps[gap].pop()
            take = min(many, left[n])
            if take < many:
                gaps[gap].append((first + take, many - take))
            put(n, take, first, capacity - gap)
            leave(gap - n, first, take)
    return places, n_sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, among them doc_id, piece and length)."""
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan_packing(histogram, capacity)
    places.sort()
    table = np.array(places or [(0, 0, 0, 0, 0)], np.int64)
    keys = (table[:, 0] << 44) + table[:, 1]
    chunk = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunk_count(sum(histogram.values()))))
    ranked = running_total(pieces.withColumn("_chunk", chunk), ["length"], "_chunk", [F.col("doc_id"), F.col("piece")], F.lit(1), "_rank").drop("_chunk")

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        row = table[np.searchsorted(keys, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), "right") - 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + rank.to_numpy(np.int64) - row[:, 1], "offset": row[:, 4]})

    return ranked.withColumn("_place", place("length", "_rank")).select("*", "_place.*").drop("_place", "_rank")


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = materialize(cut_pieces(docs))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
