"""Operator 4: quality classifier, hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text: its words in lower case, their shapes (runs of capitals, small letters, digits and
each other character, so that words never seen still tell), and the bigrams of both, where a word that
repeats its predecessor counts as one fixed bigram.  All are hashed into ``2**BITS`` weights; a feature's
value is its count per word.  A score is one sparse dot product and a logistic function.

Learning: per-coordinate FTRL-proximal over at most ``SAMPLE_DOCS`` labelled documents (the smallest by a
hash of doc_id; a documented bound, so that the fit doesn't grow with the corpus), several passes.

Edge cases: null and empty texts score by the bias alone; labels that are null, or of documents that don't
exist, are skipped; a document labelled twice learns from the larger label; without any labels all scores
are 0.5; repeated rows score alike; extra columns are kept by ``score_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .batches import held_out, learnable, with_text_columns

BITS = 18
SAMPLE_DOCS = 4000
THRESHOLD = 0.3
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 0.5, 0.02, 0.1
PASSES, SCALE = 4, 40.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = 1
_SHAPE[ord("a") : ord("z") + 1] = 2
_SHAPE[0x80:] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_REPEAT = np.uint64(0xD6E8FEB86659FD93)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all rows (with repeats), the row of each, and each row's number of words."""
    starts, ends, rows = tb.word_spans(data, offsets)
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    words = tb.span_hashes(tb.LOWER[data], starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    position = np.cumsum(keep)
    shapes = tb.span_hashes(shape[keep], position[starts] - 1, position[ends - 1])
    pair = rows[1:] == rows[:-1]
    both = []
    for h in (words, shapes):
        two = tb.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
        both.append(np.where(words[1:] == words[:-1], _REPEAT, two)[pair])
    hashed = np.concatenate((words, tb.mix(shapes + np.uint64(1)), *both))
    where = np.concatenate((rows, rows, rows[1:][pair], rows[1:][pair]))
    return (hashed >> np.uint64(64 - BITS)).astype(np.int64), where, n_words


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (indices, values, label) of each document, in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(i: np.ndarray) -> np.ndarray:
        small = np.abs(z[i]) <= L1
        return np.where(small, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for index, value, label in rows:
            i, x = np.append(index, bias), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    all_weights = weights(np.arange(bias + 1))
    return all_weights[:bias].astype(np.float32), float(all_weights[bias])


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Fits the classifier on a bounded sample of labelled documents."""
    chosen = labels.filter(F.col("quality").isNotNull() & learnable()).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for k in range(batch.num_rows):
                index, _, n = features(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
                own, times = np.unique(index, return_counts=True)
                value = (times * (SCALE / max(1, int(n[0])))).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1).cast(pa.int64()), batch.column("_label").slice(k, 1).cast(pa.int32()), pa.array([own.astype("<i4").tobytes()]), pa.array([value.tobytes()])], names=["doc_id", "label", "own", "value"])

    # one row for each chosen doc_id, however often the documents repeat it
    counted = texts.mapInArrow(count, "doc_id long, label int, own binary, value binary")
    counted = counted.groupBy("doc_id").agg(F.min(F.struct("label", "own", "value")).alias("_one")).select("doc_id", "_one.*")
    got = sorted(counted.toPandas().itertuples(index=False), key=lambda r: (hash(r.doc_id * 2654435761 % (1 << 32)), r.doc_id, r.own))
    return fit([(np.frombuffer(r.own, "<i4").astype(np.int64), np.frombuffer(r.value, "<f4").astype(float), int(r.label)) for r in got])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1; all other columns stay."""
    weights, bias = model

    def score(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        index, rows, n_words = features(data, offsets)
        dot = np.bincount(rows, weights=weights[index], minlength=len(offsets) - 1) * SCALE / np.maximum(n_words, 1) + bias
        return [pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))]

    return with_text_columns(docs, [T.StructField(column, T.DoubleType())], score)


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
