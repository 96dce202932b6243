"""Operator 6: exact top-k by inner product, on an impact-ordered score-at-a-time index.

Candidates are hashed into shards of about ``SHARD`` vectors; queries go to the shards, ``BLOCK`` at a time, so that
an index is built once for so many.  A shard's index has one posting list per component, ordered by value, so that
the largest impacts (query component times value) stand at one end.  A query takes posting segments in rounds of
falling impact level, all lists down to the level, and adds their impacts to accumulators.  What a vector can still
gain is less than the level for each component not seen.  A query ends a shard only when that bound proves that all
but a few can't be members of its top k; those few are scored again exactly, from their whole vectors.

Components become floor(1024 * x); scores are integers and ties go to the smaller vec_id.

Edge cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without
a vec_id; of vectors of different lengths the shorter one counts as ended by zeros; empty vectors score 0;
rows that repeat a vec_id are candidates each, but never of their own id's query; a query id that repeats is
answered once for each different vector; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT, K, QUERY_STEP = 1024, 10, 100
#: Vectors of a shard, queries that meet it at once, about.
SHARD, BLOCK = 16384, 4096
#: Impact levels of the rounds, as shares of a query's largest impact; after these they fall by four each.
LEVELS = (1 / 8, 0.0, -1 / 32, -1 / 8)
#: Rounds stop when at most this share of a shard can still be among the best: to score those exactly costs less than a round.
FEW = 1 / 8
NEVER = -(1 << 62)
#: Sums of doubles are exact below this.
EXACT = 1 << 53


def quantised(vector: Column) -> Column:
    """Components as integers; null unless all are finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * UNIT)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as rows of a matrix, the shorter ones ended by zeros."""
    lists = column.combine_chunks()
    values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _width(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


class ImpactIndex:
    """Posting lists of one shard (rows of ``lists`` and ``values``), ordered by value within each component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.lists = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, self.lists.T, axis=0).T)
        self.largest = float(np.abs(vectors).max(initial=0))
        self.numbers = {t: (vectors.astype(t), self.values.astype(t)) for t in (np.float64, np.int64)}

    def search(self, query: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best allowed rows, by falling score and rising id."""
        n, live = len(self.vectors), np.flatnonzero(query)
        weights = query[live]
        # in doubles, if they are exact, an accumulator holds the sum of a row's impacts, times unit, and how many they are
        unit = 1 << len(live).bit_length()
        exact = float(np.abs(weights).sum()) * max(self.largest, 1) * unit < EXACT
        unit = unit if exact else 1
        vectors, values = self.numbers[np.float64 if exact else np.int64]
        query = query.astype(values.dtype)
        accumulators, sums, seen = np.zeros(n), np.zeros(n, values.dtype), np.zeros(n, np.int64)
        top = int(np.maximum(self.values[live, 0] * weights, self.values[live, -1] * weights).max(initial=1))
        done, best, step = [0] * len(live), np.zeros(0, np.int64), 0
        while True:
            share = LEVELS[step] if step < len(LEVELS) else LEVELS[-1] * 4.0 ** (step - len(LEVELS) + 1)
            level, step = int(top * share), step + 1
            rows, impacts = [], []
            for j, (d, q) in enumerate(zip(live.tolist(), weights.tolist())):
                column, taken = self.values[d], done[j]
                if q > 0:  # the largest values first: all with q * v >= level
                    done[j] = n - int(column.searchsorted(-(-level // q)))
                    span = slice(n - done[j], n - taken)
                else:
                    done[j] = int(column.searchsorted(level // q, "right"))
                    span = slice(taken, done[j])
                if done[j] > taken:
                    rows.append(self.lists[d, span])
                    impacts.append(values[d, span] * (q * unit))
            if rows:
                at, gain = np.concatenate(rows), np.concatenate(impacts)
                if exact:
                    gain += 1
                    accumulators += np.bincount(at, gain, n)
                    sums = np.floor(accumulators / unit)
                    seen = accumulators - sums * unit
                else:
                    np.add.at(sums, at, gain)
                    seen += np.bincount(at, minlength=n)
            ended = min(done, default=n) == n
            # a component not seen yet adds less than the level
            bound = sums if ended else sums + (len(live) - seen) * (level - 1)
            bound = np.where(allowed, bound, NEVER)
            best = np.union1d(best, np.argpartition(-bound, min(k, n - 1))[: k + 1])
            best = best[allowed[best]]
            known = np.sort(vectors[best] @ query)[::-1]
            possible = np.flatnonzero(allowed & (bound >= known[k - 1])) if len(known) >= k else np.flatnonzero(allowed)
            if ended or len(possible) <= FEW * n:
                break
        scores = (vectors[possible] @ query).astype(np.int64)
        order = np.lexsort((ids[possible], -scores))[:k]
        return possible[order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best vectors for each query: query_id, rank, vec_id, score.  Both inputs are (vec_id, embedding)."""
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null")
    candidates, asked = clean(vectors), clean(queries).distinct()
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, SHARD), (queries, BLOCK)))
    key = F.xxhash64("vec_id", "v")
    left = candidates.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("query", key)

    def meet(own: pa.Table, asks: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if own.num_rows and asks.num_rows:
            width = max(_width(t.column("v")) for t in (own, asks))
            index, ids = ImpactIndex(_matrix(own.column("v"), width)), own.column("vec_id").to_numpy()
            for query_id, code, query in zip(asks.column("vec_id").to_pylist(), asks.column("query").to_pylist(), _matrix(asks.column("v"), width)):
                rows, scores = index.search(query, ids != query_id, ids, k)
                for x, more in zip(out, (np.full(len(rows), query_id), np.full(len(rows), code), ids[rows], scores)):
                    x.append(more)
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("query_id", "query", "vec_id", "score"), out)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "query_id long, query long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
