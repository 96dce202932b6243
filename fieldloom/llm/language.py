"""Operator 7: language of a text by a convolutional network over its bytes.

A text is cut into windows of ``WINDOW`` bytes, the last one padded with zeros.  Bytes are embedded;
filters of several widths slide over the window; their largest response anywhere in it goes through a
softmax layer.  A text's prediction is the mean of its windows' log-probabilities: every byte counts.

The network is trained with numpy (Adam) on one window each of at most ``PARTS * PER_PART`` documents a
language (a documented bound), chosen by hash.

Edge cases: texts that are null or have no letter are ``und`` with score 0; languages that are null are not
learnt; without any language to learn all are ``und``; repeated rows are predicted alike; extra columns are
kept by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .batches import held_out, learnable, with_text_columns

WINDOW, EMBED, WIDTHS, FILTERS = 192, 6, (2, 3, 4), 12
PARTS, PER_PART = 256, 4
PASSES, BATCH, RATE = 10, 64, 0.01
UNKNOWN = "und"


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows, padded, and the row of each; an empty row has one window of zeros."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // WINDOW))
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], sizes)] = data
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(sizes)), counts)


class ByteNetwork:
    """Embedding, convolutions of several widths, max pooling over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        self.languages, total = languages, FILTERS * len(WIDTHS)
        self.p = {
            "embed": draw.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": draw.normal(0, 0.3, (max(WIDTHS) * EMBED, total)).astype(np.float32),
            "bias": np.zeros(total, np.float32),
            "out": draw.normal(0, 0.1, (total, len(languages))).astype(np.float32),
            "out_bias": np.zeros(len(languages), np.float32),
        }
        self.mask = np.zeros_like(self.p["conv"])
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p["conv"] *= self.mask

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """For each position the embeddings of the bytes from there on, as many as the widest filter needs."""
        n, wide = len(windows), max(WIDTHS)
        padded = np.zeros((n, WINDOW + wide - 1), np.uint8)
        padded[:, :WINDOW] = windows
        e = self.p["embed"][padded]
        view = np.lib.stride_tricks.as_strided(e, (n, WINDOW, wide * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
        return np.ascontiguousarray(view).reshape(n * WINDOW, wide * EMBED)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        response = (self._columns(windows) @ self.p["conv"]).reshape(len(windows), WINDOW, -1)
        return np.maximum(response.max(axis=1) + self.p["bias"], 0)

    def log_probabilities(self, windows: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for low in range(0, len(windows), step):
            logits = self.pooled(windows[low : low + step]) @ self.p["out"] + self.p["out_bias"]
            logits -= logits.max(axis=1, keepdims=True)
            out[low : low + step] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n, wide = len(windows), max(WIDTHS)
        columns = self._columns(windows)
        response = (columns @ self.p["conv"]).reshape(n, WINDOW, -1)
        at = response.argmax(axis=1)
        top = np.take_along_axis(response, at[:, None, :], 1)[:, 0] + self.p["bias"]
        hidden = np.maximum(top, 0)
        logits = hidden @ self.p["out"] + self.p["out_bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        back = (p @ self.p["out"].T) * (top > 0)
        seen = columns.reshape(n, WINDOW, -1)[np.arange(n)[:, None], at]  # window, filter, its inputs
        embed = np.zeros_like(self.p["embed"])
        to_input = (back[:, :, None] * self.p["conv"].T[None]).reshape(n, -1, wide, EMBED)
        padded = np.zeros((n, WINDOW + wide - 1), np.uint8)
        padded[:, :WINDOW] = windows
        symbols = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)]
        np.add.at(embed, symbols.reshape(-1), to_input.reshape(-1, EMBED))
        return {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "conv": np.einsum("nf,nfk->kf", back, seen) * self.mask, "embed": embed}

    def train(self, windows: np.ndarray, labels: np.ndarray) -> ByteNetwork:
        draw, step = np.random.default_rng(11), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for turn in range(PASSES):
            order = draw.permutation(len(windows))
            for low in range(0, len(order), BATCH):
                some = order[low : low + BATCH]
                step += 1
                rate = RATE * (1 - turn / PASSES)
                for k, g in self.gradients(windows[some], labels[some]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def learn(docs: DataFrame) -> ByteNetwork | None:
    """Trains the network on a bounded sample of documents with a language; None if there is none."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & learnable())
    part = Window.partitionBy("lang", "_part").orderBy("_order", "doc_id")
    known = known.withColumn("_order", F.xxhash64("doc_id")).withColumn("_part", F.pmod("_order", F.lit(PARTS)))
    chosen = known.withColumn("_n", F.row_number().over(part)).filter(f"_n <= {PER_PART}").select("doc_id", F.col("lang").alias("_lang"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen.distinct()), "doc_id")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            picked = []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                windows, _ = cut_windows(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
                picked.append(windows[doc_id * 2654435761 % len(windows)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("_lang"), pa.array(picked)], names=["doc_id", "lang", "bytes"])

    got = texts.mapInArrow(pick, "doc_id long, lang string, bytes binary").toPandas().sort_values(["doc_id", "lang", "bytes"])
    if not len(got):
        return None
    languages = sorted(got.lang.unique())
    windows = np.frombuffer(b"".join(got.bytes), np.uint8).reshape(-1, WINDOW)
    return ByteNetwork(languages).train(windows, got.lang.map({x: k for k, x in enumerate(languages)}).to_numpy())


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``docs`` with lang_pred and score from each whole text; all other columns stay."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    docs = docs.drop("lang_pred", "score")
    if network is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    def predict(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        windows, rows = cut_windows(data, offsets)
        logs = network.log_probabilities(windows)
        mean = np.add.reduceat(logs, np.searchsorted(rows, np.arange(len(offsets) - 1)), axis=0) / np.bincount(rows)[:, None]
        best = mean.argmax(axis=1)
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        return [pa.array([network.languages[k] for k in best]), pa.array((p.max(axis=1) / p.sum(axis=1)).astype(float))]

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = with_text_columns(docs, added, predict)
    return out.withColumn("_lettered", lettered).withColumns({"lang_pred": F.when(F.col("_lettered"), F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(F.col("_lettered"), F.col("score")).otherwise(0.0)}).drop("_lettered")


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
