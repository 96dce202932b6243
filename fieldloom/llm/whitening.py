"""Operator 12: whitening of embeddings, with moments that stream and merge, and a symmetric QR eigen-solve.

A task goes over its rows once and updates count, sum and co-moments by Welford's rank-one steps: each row adds the
product of its deviation from the mean so far with itself, times (k - 1) / k.  The steps of a batch are one matrix
product, as the means so far are sums of integers and known at once.  Tasks give one line per row of the co-moment
matrix; the lines of all tasks meet by that row's number and are merged by the parallel update formula.  So a merge sees
as many lines as there are tasks, and the driver gets one matrix, of the square of the dimensions whatever the number
of rows (at 64 dimensions 32 kB).  Its eigenvectors come from Householder reduction to a tridiagonal matrix and QR steps
with Wilkinson shifts.

Entries c become integers x = floor(64 * c) + 1000000, so that sums are exact in any order.

Edge cases: vectors that are null, or hold null, non-finite or (beyond 2**56) unrepresentable components, take no part;
of vectors of different lengths the shorter ones count as ended by zeros; rows that repeat, or have no vec_id, count and
are whitened each; a component whose eigenvalue is zero (no more than rounding of the largest) has a null ``whitened``
and is left out of ``identity_error``; a ``deviation`` beyond a long is null; of an empty table nothing is left, and
there are no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The integer form of an entry; components that are returned.
UNIT, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries from here on have no exact integer form.
LARGEST = float(1 << 56)
#: Rows that are worked on together.
ROWS = 4096
LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Entries as doubles; null unless all are finite and have an integer form."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return F.when(F.coalesce(good, F.lit(False)), doubles)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as rows of a matrix of the integer forms; shorter ones are ended by zeros' form."""
    values = np.floor(UNIT * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + SHIFT
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.full((len(sizes), width), SHIFT, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def width_of(column: pa.Array) -> int:
    return int(np.diff(column.offsets.to_numpy()).max(initial=0))


class Moments:
    """Count, exact sums, and co-moments about the mean of rows of integers (or of doubles, whose sums are rounded)."""

    def __init__(self, width: int = 0, rest: int = SHIFT):
        #: ``rest`` is what the entries of rows so far are, in dimensions that come up later.
        self.n, self.sums, self.co, self.rest = 0, [0] * width, np.zeros((width, width)), rest

    def widen(self, width: int) -> None:
        more = width - len(self.sums)
        if more > 0:
            self.sums = self.sums + [self.n * self.rest] * more
            self.co = np.pad(self.co, (0, more))

    def add(self, rows: np.ndarray) -> None:
        """Welford's step for each row, all in one product."""
        count, width = rows.shape
        if not count:
            return
        self.widen(width)
        exact = rows.dtype == np.int64 and float(np.abs(rows).max(initial=0)) * count < LONG / 2
        running = np.cumsum(rows if exact or rows.dtype != np.int64 else rows.astype(object), axis=0)
        k = self.n + np.arange(1, count + 1, dtype=np.float64)
        # the mean before each row, less the first row: differences of large, close numbers are taken between integers
        base = rows[0]
        own = np.vstack((np.zeros((1, width)), (running - base * np.arange(1, count + 1)[:, None]).astype(np.float64)[:-1]))
        past = np.array([s - self.n * int(b) for s, b in zip(self.sums, base)], object).astype(np.float64) if rows.dtype == np.int64 else np.array(self.sums) - self.n * base
        before = (past + own) / np.maximum(k - 1, 1)[:, None]
        delta = (rows - base).astype(np.float64) - before
        weight = (k - 1) / k
        self.co += delta.T @ (delta * weight[:, None])
        self.sums = [s + (int(t) if rows.dtype == np.int64 else float(t)) for s, t in zip(self.sums, running[-1])]
        self.n += count


def merge(n: int, sums: list, line: np.ndarray, n2: int, sums2: list, line2: np.ndarray, row: int) -> tuple[int, list, np.ndarray]:
    """Line ``row`` of the co-moments of two sets of rows together, by the parallel update formula."""
    if not n or not n2:
        return (n2, sums2, line2) if not n else (n, sums, line)
    # the difference of the means, times n * n2, is exact
    gap = np.array([a * n2 - b * n for a, b in zip(sums, sums2)], object).astype(np.float64) / (float(n) * n2)
    return n + n2, [a + b for a, b in zip(sums, sums2)], line + line2 + gap[row] * gap * (float(n) * n2 / (n + n2))


def moments(rows: DataFrame, read) -> tuple[int, list, np.ndarray]:
    """Count, sums and co-moments of all rows; ``read`` makes a matrix of a batch's first column."""
    state = "line int, task int, width int, n long, sums array<string>, co array<double>"

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = Moments(), TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                own.add(read(batch.column(0).slice(low, ROWS)))
        width = len(own.sums)
        sums = _texts(own.sums)
        if own.n:
            for low in range(0, max(width, 1), 64):  # few lines a batch: each is as long as the matrix is wide
                lines = range(low, min(max(width, 1), low + 64))
                yield pa.RecordBatch.from_pylist([{"line": i, "task": task, "width": width, "n": own.n, "sums": sums, "co": own.co[i] if width else []} for i in lines], schema=_STATE)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        row, n, sums, line = key[0].as_py(), 0, [], np.zeros(0)
        width = max(table.column("width").to_pylist())
        for r in table.sort_by([("task", "ascending")]).to_pylist():
            own = _numbers(r["sums"])
            n, sums, line = merge(n, sums, line, r["n"], own + [r["n"] * SHIFT] * (width - len(own)), np.pad(np.array(r["co"], np.float64), (0, width - len(r["co"]))), row)
        return pa.Table.from_pylist([{"line": row, "task": 0, "width": width, "n": n, "sums": _texts(sums), "co": line}], schema=_STATE)

    lines = rows.mapInArrow(collect, state).groupBy("line").applyInArrow(join, state).collect()
    if not lines:
        return 0, [], np.zeros((0, 0))
    lines.sort(key=lambda r: r["line"])
    n, sums, co = lines[0]["n"], _numbers(lines[0]["sums"]), []
    for r in lines[: len(sums)]:
        # tasks of shorter vectors have no such line: their entries there are all the same
        own, count = _numbers(r["sums"]), n - r["n"]
        co.append(merge(r["n"], own, np.array(r["co"]), count, [a - b for a, b in zip(sums, own)], np.zeros(len(sums)), r["line"])[2])
    return n, sums, np.array(co).reshape(len(sums), len(sums))


def _texts(sums: list) -> list[str]:
    """Sums as texts that keep them exactly: integers of any size, or doubles."""
    return [str(s) if isinstance(s, int) else float(s).hex() for s in sums]


def _numbers(texts: list[str]) -> list:
    return [float.fromhex(s) if "x" in s else int(s) for s in texts]


_STATE = pa.schema([("line", pa.int32()), ("task", pa.int32()), ("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("co", pa.list_(pa.float64()))])


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reduction of a symmetric matrix A: diagonal d, subdiagonal e and orthogonal Q with A = Q T Q'."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = float(np.linalg.norm(x))
        if size == 0 or not np.any(x[1:]):
            continue
        x[0] += size if x[0] >= 0 else -size
        v = x / np.linalg.norm(x)
        p = 2 * (a[k + 1 :, k + 1 :] @ v)
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -size if x[0] > 0 else size
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by implicit QR steps with Wilkinson shifts."""
    n = len(matrix)
    if n == 0:
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(matrix)
    turns = np.ascontiguousarray(q.T)  # rows are turned in pairs
    last, smallest = n - 1, np.finfo(float).eps
    steps = 0
    while last > 0:
        small = np.abs(e[:last]) <= smallest * (np.abs(d[:last]) + np.abs(d[1 : last + 1]))
        e[:last][small] = 0
        if e[last - 1] == 0:
            last, steps = last - 1, 0
            continue
        steps += 1
        if steps > 60:
            raise ArithmeticError("QR steps don't converge")
        first = last - 1
        while first > 0 and e[first - 1] != 0:
            first -= 1
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + (np.hypot(half, e[last - 1]) if half >= 0 else -np.hypot(half, e[last - 1])))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            a, b, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a + 2 * c * s * f + s * s * b, s * s * a - 2 * c * s * f + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * f
            if k < last - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] = c * e[k + 1]
            turns[k], turns[k + 1] = c * turns[k] + s * turns[k + 1], c * turns[k + 1] - s * turns[k]
    order = np.argsort(-d, kind="stable")
    return d[order], turns[order].T


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: rows, exact sums, trace of the covariance, and eigenvalues with their vectors (rows)."""

    n: int
    sums: tuple
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0), 0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integers, one column a component; nan where the component is not usable."""
        # x - S / n, with the difference taken between integers first
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s - self.n * (s // self.n)) / self.n for s in self.sums])
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1)), np.nan)
        return ((x - near).astype(np.float64) - rest) @ self.vectors.T / scale

    def deviations(self, x: np.ndarray) -> list:
        """The exact sum over dimensions of (n * x - S) squared; None where it is no long."""
        most = max([abs(s) for s in self.sums] + [self.n * int(np.abs(x).max(initial=0))])
        gap = x * self.n - np.array(self.sums, np.int64) if most < LONG // 2 else x.astype(object) * self.n - np.array(self.sums, object)
        wide = float(np.abs(gap).max(initial=0)) if gap.dtype != object else float(max(map(abs, gap.reshape(-1).tolist()), default=0))
        if wide * wide * max(1, x.shape[1]) < LONG / 2:
            return (gap.astype(np.int64) ** 2).sum(1).tolist()
        return [t if t < LONG else None for t in (sum(v * v for v in row) for row in gap.tolist())]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable rows of a column of vectors."""
    rows = vectors.select(usable(F.col(column)).alias("v")).filter("v is not null")
    n, sums, co = moments(rows, lambda c: integers(c, width_of(c)))
    values, directions = symmetric_qr(co / n) if n else (np.zeros(0), np.zeros((0, 0)))
    return Whitening(n, tuple(sums), float(np.trace(co) / n) if n else 0.0, values[:components], directions.T[:components])


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest entry of the whitened rows' covariance less the identity, from the rows."""
    rows = vectors.select(usable(F.col(column)).alias("v")).filter("v is not null")
    kept, width = model.usable, len(model.sums)
    n, _, co = moments(rows, lambda c: model.project(integers(c, width))[:, kept])
    return float(np.abs(co / n - np.eye(len(co))).max(initial=0)) if n else 0.0


def whiten(vectors: DataFrame, model: Whitening, error: float, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each usable row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col(column)).alias("v")).filter("v is not null")
    width, kinds = len(model.sums), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(kinds, np.nan)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                x, count = integers(part.column(1), width), part.num_rows
                each = pa.array(np.repeat(np.arange(count), kinds))
                number = lambda a: pa.array(a, pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, kinds + 1, dtype=np.int32), count)), pa.array(np.full(count * kinds, model.n, np.int64)),
                    pa.array(model.deviations(x), pa.int64()).take(each), number(model.project(x).reshape(-1)), number(np.tile(explained, count)), pa.array(np.full(count * kinds, error)),
                ], names=names)

    return rows.mapInArrow(work, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    return whiten(vectors, model, identity_error(vectors, model))
