"""Operator 10: n-gram Jaccard join by vertical partitioning.

Documents are sets of word shingles; documents with equal sets are one class.  A global order of shingles
(rare before frequent by a count sketch of fixed size, then by hash) makes two classes that reach the
threshold share one of their first shingles, where in addition their sizes and the positions of that shingle
leave room for enough overlap.

Overlaps are counted vertically: the global order is cut into ``FRAGMENTS`` of about equal numbers of shingles; each
pair's shingles meet fragment by fragment, partial overlaps are counted separately and summed per pair.

Before a pair's sets travel, parity bitmaps bound its overlap: each shingle flips one of 2 to 4 bits per shingle of
its class, and two sets differ in at least as many shingles as their bitmaps differ in bits.  Pairs whose bound
is below the threshold are dropped, which loses no link.

Pairs come in three rounds, which lose no link and don't list all pairs of a group:

1. each class is paired with two partners at most, those that most of its shared first shingles propose among
   its fitting neighbours by size and whose bitmaps allow; verified links give components;
2. classes that share a first shingle and lie in *different* components are compared by bitmap where the shingle's
   classes meet; each is paired with the two that the bitmaps find nearest there;
3. the same once more with the components of both rounds, and all pairs whose bitmaps allow are verified.

What the bitmaps rule out never leaves the task.  A link that no round verifies joins classes that are connected
already.

Skew: copies collapse before anything is paired; a hub's partners are salted into groups of ``SALT`` with
the hub's set copied to each; the shingles of one family of classes are dealt to several tasks, about
``PACK_ENTRIES`` classes each; within a map task a class sends its first shingles once, however many copies it has.

Edge cases: documents without words have no set and are linked with nothing; documents with fewer than five
words link when all words are equal; rows with a null doc_id have n_shingles but no component_id and take no
part; repeated rows are copies; an empty table gives no rows; extra columns are ignored (kept by
``keep_one_of_each``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .graph import components
from .idfilter import id_filter, passes
from .shingles import shingle_sets
from .columns import aside
from .storage import materialize, shuffle_partitions

PERCENT = 75
SKETCH_BITS, SLICE_BITS = 20, 14
FRAGMENTS, SALT = 4, 500
# tasks' large buffers go back to the system when they are done with, and are not kept for later ones
pa.set_memory_pool(pa.system_memory_pool())

#: Shingles of one shard, about.
SHARD_SHINGLES = 1 << 18
#: Entries (class at a shingle) of a family that one task compares, about.
PACK_ENTRIES = 1 << 13
#: Groups beyond this size are walked without their largest component.
LARGE_GROUP = 64
#: Classes that a shingle proposes to each of its classes in the first round, how many of a class' proposals are
#: compared by bitmap, and how many each class tries in a round.
NEIGHBOURS, PROPOSALS, TRIES = 8, 6, 2
#: Classes that a task remembers to have sent, about.
REMEMBERED = 1 << 18
#: Pairs whose bitmaps are compared at once, about.
CHUNK = 1 << 15
#: Log2 of the bits of the smallest and the largest bitmap; beyond the largest, bounds are looser and as safe.
LEAST_BITS, MOST_BITS = 6, 16

_CLASS = np.uint64(0xA0761D6478BD642F)


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit value per row, equal for equal sets; 0 for empty ones."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix(h ^ _CLASS))))
    return tb.mix((sums[at[1:]] - sums[at[:-1]]) * (np.diff(at) > 0) ^ np.diff(at).astype(np.uint64)).astype(np.int64)


def _bitmaps(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each row, which of its 2**k bits an odd number of its shingles hit; 2**k is at least twice their number."""
    n = np.diff(at)
    width = 1 << np.clip(np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    ends = np.cumsum(width)
    row = np.repeat(np.arange(len(n)), n)
    hits = np.bincount((ends - width)[row] + (h & (width[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(width.sum()))
    packed = np.packbits((hits & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(ends - width, ends)]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, shingles and row starts of each slice of a batch with a text column."""
    data, offsets = tb.text_bytes(batch.column("text"))
    for low, high in tb.slices(offsets):
        yield low, *shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])


def _code() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def digest(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, code, n_shingles, node, bits) of each row (code tells texts apart), and the sketch: log2 of the number of shingles in each hash cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "code", "n_shingles", "node", "bits", "slice", "counts"]
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for low, h, at in _rows(batch):
                n = len(at) - 1
                sketch += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), batch.column("code").slice(low, n), pa.array(np.diff(at)), pa.array(_signatures(h, at)), pa.array(_bitmaps(h, at), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for k, part in enumerate(np.split(sketch, 1 << (SKETCH_BITS - SLICE_BITS))):
            if part.any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([part.astype("<u4").tobytes()])], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _code().alias("code"))
    out = materialize(texts.mapInArrow(work, "doc_id long, code long, n_shingles long, node long, bits binary, slice int, counts binary"))

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u4").astype(np.uint64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice").slice(0, 1), "levels": pa.array([np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()])})

    levels = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in out.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, levels binary").collect():
        levels[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    return out.filter("slice is null").drop("slice", "counts"), levels.reshape(-1)


def order_keys(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order, rare ones first, as numbers."""
    return levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | h >> np.uint64(6)


def pivots(levels: np.ndarray) -> np.ndarray:
    """Where the global order is cut into fragments of about as many shingles each."""
    order = np.argsort(levels, kind="stable")
    total = np.cumsum(2.0 ** levels[order])
    cell = order[np.searchsorted(total, total[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)]
    return levels[cell].astype(np.uint64) << np.uint64(58) | cell.astype(np.uint64) << np.uint64(58 - SKETCH_BITS)


def _prefix_length(n: np.ndarray) -> np.ndarray:
    """How many first shingles two sets of n and more shingles must look at: n - ceil(0.75 n) + 1."""
    return n - -(-PERCENT * n // 100) + 1


def _fits(n_a: np.ndarray, n_b: np.ndarray, left_a: np.ndarray, left_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold when their first common shingle leaves them so many, itself included."""
    need = -(-PERCENT * (n_a + n_b) // (100 + PERCENT))
    return np.minimum(left_a, left_b) >= need


def first_shingles(docs: DataFrame, levels: np.ndarray, shards: int) -> DataFrame:
    """(shard, packed): the first shingles of each document, with class, size and position, packed by shard."""
    entry = np.dtype([("shingle", "<u8"), ("node", "<i8"), ("n", "<i4"), ("place", "<i4")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, h, at in _rows(batch):
                sizes, nodes = np.diff(at), _signatures(h, at)
                once = np.array([x not in sent and not sent.add(x) for x in nodes.tolist()], bool)  # copies in this task send nothing
                if len(sent) > REMEMBERED:  # forgetting only sends a class again
                    sent.clear()
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((h, levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))
                place = np.arange(len(h)) - at[row]
                keep = (place < _prefix_length(sizes)[row]) & once[row]
                out = np.empty(int(keep.sum()), entry)
                row = row[keep]
                out["shingle"], out["node"], out["n"], out["place"] = h[order][keep], nodes[row], sizes[row], place[keep]
                shard = (out["shingle"] & np.uint64(0xFFFFFFFF)).astype(np.int64) * shards >> 32
                by = np.argsort(shard, kind="stable")
                out, shard = out[by], shard[by]
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                ends = np.append(cuts[1:], len(out))
                packed = [b"".join(out[name][a:b].tobytes() for name in entry.names) for a, b in zip(cuts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts], pa.int32()), pa.array(packed, pa.binary())], names=["shard", "packed"])

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.mapInArrow(work, "shard int, packed binary")


def _unpack(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, classes, sizes and positions of packed rows, each (shingle, class) once, by shingle and size."""
    columns = [[], [], [], []]
    for v in values:
        m = len(v) // 24
        for column, kind, start in zip(columns, ("<u8", "<i8", "<i4", "<i4"), (0, 8 * m, 16 * m, 20 * m)):
            column.append(np.frombuffer(v, kind, m, start))
    shingle, node, n, place = (np.concatenate(c) for c in columns)
    order = np.lexsort((node, n, shingle))
    shingle, node, n, place = shingle[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
    return shingle[new], node[new], n[new], place[new]


def _has_partner(shingle: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether another class of the shingle (rows are in order of shingle and size) has a size that this place still allows."""
    if not len(n):
        return np.zeros(0, bool)
    group = np.cumsum(np.diff(shingle, prepend=shingle[:1]) != 0) << 40
    most = np.minimum(100 * n // PERCENT, (n - place) * (100 + PERCENT) // PERCENT - n)
    low = np.searchsorted(group + n, group + -(-PERCENT * n // 100))
    high = np.searchsorted(group + n, group + most, "right")
    return high - low - (most >= n) > 0


def shared_first_shingles(packed: DataFrame) -> DataFrame:
    """Classes with a first shingle that another class of a fitting size has too: (shard, shingle, node, n, place, partners).

    ``partners`` are fitting classes at that shingle: of the ``NEIGHBOURS`` before this one by size, and the
    first that is large enough.
    """

    def meet(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        shingle, node, n, place = _unpack(table.column("packed").to_pylist())
        for _ in range(2):  # those without partners leave others without any
            kept = _has_partner(shingle, n, place)
            shingle, node, n, place = (x[kept] for x in (shingle, node, n, place))
        group = np.cumsum(np.diff(shingle, prepend=shingle[:1] + np.uint64(1)) != 0) if len(shingle) else np.zeros(0, np.int64)
        index = np.arange(len(shingle))
        # rows are ordered by group and size: the first row of the group that is large enough, and the row just before
        first = np.searchsorted(group * (1 << 40) + n, group * (1 << 40) + -(-PERCENT * n // 100))
        others = [index - lag for lag in range(1, NEIGHBOURS + 1)] + [np.where(first < index - NEIGHBOURS, first, -1)]
        names, fits = [], []
        for other in others:
            ok = (other >= first) & (other < index) & (other >= 0)
            o = np.where(ok, other, 0)
            fits.append(ok & _fits(n[o], n, n[o] - place[o], n - place) if len(n) else ok)
            names.append(node[o])
        fits, names = np.stack(fits, axis=1), np.stack(names, axis=1)
        bounds = np.concatenate(([0], np.cumsum(fits.sum(axis=1)))).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(names[fits], pa.int64()))
        return pa.table({"shard": pa.array(np.full(len(node), shard), pa.int32()), "shingle": pa.array(shingle.astype(np.int64)), "node": pa.array(node), "n": pa.array(n), "place": pa.array(place), "partners": found})

    return packed.groupBy("shard").applyInArrow(meet, "shard int, shingle long, node long, n long, place long, partners array<long>")


class Bitmaps:
    """Parity bitmaps of rows; those of one width lie in one matrix of 64-bit words."""

    def __init__(self, bits: list[bytes], n: np.ndarray):
        self.n, self.width = n, np.array([len(x) for x in bits], np.int64) // 8
        self.place, self.words = np.zeros(len(bits), np.int64), {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.words[w] = np.frombuffer(b"".join(bits[k] for k in rows), "<u8").reshape(len(rows), w)

    def _folded(self, rows: np.ndarray, width: int, narrow: int) -> np.ndarray:
        """Bitmaps of rows of one width, folded by parity onto a narrower one."""
        words = self.words[width][self.place[rows]]
        return words if width == narrow else np.bitwise_xor.reduce(words.reshape(len(rows), width // narrow, narrow), axis=1)

    def slack(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By how much the largest possible overlap of rows i and j exceeds what they need; negative if they can't be linked."""
        n, apart = self.n[i] + self.n[j], np.zeros(len(i), np.int64)
        code = self.width[i] << 32 | self.width[j]
        for c in np.unique(code).tolist():
            w, v = c >> 32, c & 0xFFFFFFFF
            at = np.flatnonzero(code == c)
            for low in range(0, len(at), CHUNK):
                k = at[low : low + CHUNK]
                a, b = self._folded(i[k], w, min(w, v)), self._folded(j[k], v, min(w, v))
                apart[k] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return (n - apart) // 2 - -(-PERCENT * n // (100 + PERCENT))


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, votes) of classes that their bitmaps don't rule out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 11):
                part = batch.slice(low, 1 << 11)
                both = Bitmaps(part.column("bits_a").to_pylist() + part.column("bits_b").to_pylist(), np.concatenate([part.column(x).to_numpy() for x in ("n_a", "n_b")]))
                row = np.arange(part.num_rows)
                yield part.select(["a", "b", "votes"]).filter(pa.array(both.slack(row, row + len(row)) >= 0))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.select("a", "b", "votes").join(side("a"), "a").join(side("b"), "b").mapInArrow(work, "a long, b long, votes long")


def verify(docs: DataFrame, levels: np.ndarray, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold.

    Each class' set goes to the groups of its pairs, cut into fragments; partial overlaps are summed per pair.
    Only texts of wanted classes (as a filter of fixed size tells) are read as sets and leave their tasks.
    """
    salted = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    pairs = pairs.join(salted, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    sends = pairs.select("a", "salt", F.col("b").alias("node")).unionByName(pairs.select("a", "salt", F.col("a").alias("node")).distinct())
    sends = materialize(sends.join(classes.select("node", "doc_id"), "node"))
    wanted, cuts = id_filter(sends.select("doc_id").distinct()), pivots(levels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column("doc_id").to_numpy())))
            for low, h, at in _rows(batch):
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                fragment = np.searchsorted(cuts, order_keys(h, levels), "right")
                order = np.lexsort((h, fragment, row))
                ends = np.cumsum(np.bincount(row * FRAGMENTS + fragment, minlength=(len(at) - 1) * FRAGMENTS))
                raw = h[order].astype("<u8").tobytes()
                parts = [raw[8 * a : 8 * b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(_signatures(h, at), FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(at) - 1)), pa.array(parts, pa.binary())], names=["node", "fragment", "shingles"])

    def overlap(table: pa.Table) -> pa.Table:
        hub = table.column("a")[0].as_py()
        sets = {x: np.frombuffer(s, "<u8") for x, s in zip(table.column("node").to_pylist(), table.column("shingles").to_pylist())}
        mine = sets.pop(hub, np.zeros(0, "<u8"))
        size = np.array([len(s) for s in sets.values()], np.int64)
        hit = np.isin(np.concatenate(list(sets.values()) or [mine[:0]]), mine)
        both = np.diff(np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(size)))])
        return pa.table({"a": pa.array([hub] * len(sets), pa.int64()), "b": pa.array(list(sets), pa.int64()), "part": pa.array(both)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    fragments = texts.mapInArrow(cut, "node long, fragment int, shingles binary").join(sends.drop("doc_id"), "node")
    parts = fragments.groupBy("a", "salt", "fragment").applyInArrow(overlap, "a long, b long, part long")
    whole = parts.groupBy("a", "b").agg(F.sum("part").alias("both"))
    size = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    return whole.join(size("a"), "a").join(size("b"), "b").filter(f"100 * both >= {PERCENT} * (n_a + n_b - both)").select("a", "b")


def crossing_pairs(shared: DataFrame, found: DataFrame, classes: DataFrame, packs: int, tries: int | None = None) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a first shingle, fit, and whose bitmaps allow a link.

    Only shingles with several components are looked at.  Their classes are grouped with those of similar
    size: band k holds sizes from (4/3)**k on, and each class also visits the band above its own.  Many groups
    are packed together, so that a task walks them in a few vector steps; shingles whose least component is the same
    (a family) are dealt to as few packs as hold them, so that a pair isn't found too often and a class' bitmap is
    sent to few tasks.

    With ``tries``, only the pairs that have most slack, so many for each class.
    """
    rows = shared.drop("partners").join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
    rows = rows.withColumn("component", F.coalesce("component", "node"))

    def several(table: pa.Table) -> pa.Table:
        """Entries at shingles with several components, and their pack."""
        shingle, component = (table.column(x).to_numpy() for x in ("shingle", "component"))
        order = np.lexsort((component, shingle))
        shingle, component = shingle[order], component[order]
        first = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] - 1))
        sizes = np.diff(np.append(first, len(shingle)))
        family, last = component[first], component[first + sizes - 1]
        apart = family != last
        # a family has about as many entries in each shard
        _, which = np.unique(family, return_inverse=True)
        entries = np.bincount(which, sizes * apart)[which] * packs
        salt = shingle[first].astype(np.uint64) % np.maximum(1, np.ceil(entries / PACK_ENTRIES)).astype(np.uint64)
        pack = (tb.mix(tb.mix(family.astype(np.uint64)) + salt) % np.uint64(packs)).astype(np.int32)
        keep = np.repeat(apart, sizes)
        out = table.take(pa.array(order[keep])).select(["shingle", "node", "n", "place", "component"])
        return out.add_column(0, "pack", pa.array(np.repeat(pack, sizes)[keep]))

    rows = materialize(rows.groupBy("shard").applyInArrow(several, "pack int, shingle long, node long, n long, place long, component long"))
    bits = rows.select(F.col("pack").alias("of"), F.col("node").alias("name")).distinct().join(classes.select(F.col("node").alias("name"), "bits"), "name")
    pairs = rows.groupBy("pack").cogroup(bits.groupBy("of")).applyInArrow(lambda t, u: _crossing(t, u, tries), "a long, b long, slack long")
    pairs = pairs.groupBy("a", "b").agg(F.max("slack").alias("slack"))
    if tries is None:
        return pairs.select("a", "b")
    each = pairs.select("a", "b", "slack", F.explode(F.array("a", "b")).alias("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("slack"), "a", "b"))
    return each.withColumn("_place", place).filter(F.col("_place") <= tries).select("a", "b").distinct()


def _best(a: np.ndarray, b: np.ndarray, slack: np.ndarray, tries: int) -> np.ndarray:
    """Indices of the pairs that are among the best of their a or their b."""
    keep = [np.zeros(0, np.int64)]
    for side in (a, b):
        order = np.lexsort((b, a, -slack, side))
        rank = np.arange(len(order)) - np.searchsorted(side[order], side[order])
        keep.append(order[rank < tries])
    return np.unique(np.concatenate(keep))


def _crossing(table: pa.Table, known: pa.Table, tries: int | None) -> pa.Table:
    """Possible links of different components in each group (shingle, band) of a pack of groups, by the classes' bitmaps."""
    shingle, node, n, place, component = (table.column(x).to_numpy() for x in ("shingle", "node", "n", "place", "component"))
    band = np.floor(np.log(n) / np.log(100 / PERCENT)).astype(np.int64)
    at, own = np.concatenate((band, band + 1)), np.repeat([True, False], len(n))
    shingle, node, n, place, component = (np.tile(x, 2) for x in (shingle, node, n, place, component))
    order = np.lexsort((node, at, shingle))
    shingle, at, node, n, place, component, own = (x[order] for x in (shingle, at, node, n, place, component, own))
    names, first, which = np.unique(node, return_index=True, return_inverse=True)
    spot = np.argsort(known.column("name").to_numpy())
    bits = known.column("bits").take(pa.array(spot)).to_pylist()  # in the order of names
    bitmaps = Bitmaps(bits, n[first])
    new = np.ones(len(node), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (at[1:] != at[:-1])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    out, met, waiting = [np.zeros((3, 0), np.int64)], [], 0

    def compare() -> None:
        """Compares what has met, each pair once."""
        nonlocal met, waiting
        if met:
            code = np.unique(np.concatenate(met))
            a, b = code // len(names), code % len(names)
            slack = bitmaps.slack(a, b)
            a, b, slack = a[slack >= 0], b[slack >= 0], slack[slack >= 0]
            if tries is not None:
                best = _best(a, b, slack, tries)
                a, b, slack = a[best], b[best], slack[best]
            out.append(np.stack([a, b, slack]))
        met, waiting = [], 0

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal waiting
        apart = component[i] != component[j]
        i, j = i[apart], j[apart]
        ok = (own[i] | own[j]) & _fits(n[i], n[j], n[i] - place[i], n[j] - place[j])
        a, b = which[i[ok]], which[j[ok]]
        met.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
        waiting += len(a)
        if waiting > 1 << 21:
            compare()

    small = sizes[group] <= LARGE_GROUP
    index = np.flatnonzero(small)
    for lag in range(1, int(sizes[sizes <= LARGE_GROUP].max(initial=0))):
        i, j = index[:-lag], index[lag:]
        same = group[i] == group[j]
        if not same.any():
            break
        keep(i[same], j[same])
    # in a large group, a pair of different components has a member outside the largest one; walk only those
    starts = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > LARGE_GROUP):
        every = np.arange(starts[g], starts[g] + sizes[g])
        _, code, count = np.unique(component[every], return_inverse=True, return_counts=True)
        main = code == count.argmax()
        for k in every[~main]:
            j = every[main | (every > k)]
            keep(np.full(len(j), k), j)
    compare()
    a, b, slack = np.unique(np.concatenate(out, axis=1), axis=1)
    if tries is not None:
        best = _best(a, b, slack, tries)
        a, b, slack = a[best], b[best], slack[best]
    return pa.table({"a": pa.array(names[a]), "b": pa.array(names[b]), "slack": pa.array(slack)})


def labelled(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, code, n_shingles, node, component (null without words or doc_id) and component_id."""
    own, levels = digest(docs)
    per_node = own.filter("n_shingles > 0 and doc_id is not null").groupBy("node")
    classes = materialize(per_node.agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")))
    total = own.agg(F.sum(F.col("n_shingles") * (100 - PERCENT) / 100 + 1)).first()[0] or 0
    shards = max(4 * shuffle_partitions(docs.sparkSession), int(total) // SHARD_SHINGLES)
    shared = materialize(shared_first_shingles(first_shingles(docs.filter("doc_id is not null"), levels, shards)))
    votes = shared.select(F.col("node").alias("b"), F.explode("partners").alias("a")).groupBy("a", "b").agg(F.count("*").alias("votes"))
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("votes"), "a"))
    proposals = promising(votes.withColumn("_place", place).filter(F.col("_place") <= PROPOSALS), classes)
    tries = materialize(proposals.withColumn("_place", place).filter(F.col("_place") <= TRIES).select("a", "b"))
    links = materialize(verify(docs, levels, classes, tries))
    for most in (TRIES, None):
        found = materialize(components(links))
        pairs = materialize(crossing_pairs(shared, found, classes, shards, most))
        links = materialize(links.unionByName(verify(docs, levels, classes, pairs)))
    found = materialize(components(links))
    placed = materialize(classes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    lowest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(lowest, "component").select("node", "component", "component_id")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    out = own.drop("bits").join(named, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component_id")))
    return out.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component"))).select("doc_id", "code", "n_shingles", "node", "component", "component_id")


def similar_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the one with the smallest doc_id.

    Documents without words, and rows without doc_id, stay.  Rows that share a doc_id are decided on by their own
    texts; of rows equal in doc_id and text one stays.
    """
    docs, back = aside(docs, "doc_id", "text")
    rows = labelled(docs).filter("n_shingles > 0 and component is not null")
    stays = materialize(rows.groupBy("component").agg(F.min(F.struct("doc_id", "code")).alias("s")).select(F.col("s.doc_id").alias("_d"), F.col("s.code").alias("_c")))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull(), F.lit(False))
    marked = docs.withColumns({"_d": F.col("doc_id").cast("long"), "_c": _code()})
    kept = marked.filter(worded).join(stays, ["_d", "_c"], "left_semi")
    again = F.row_number().over(Window.partitionBy("_d", "_c").orderBy("_d"))
    return back(kept.withColumn("_again", again).filter("_again = 1").select(*docs.columns).unionByName(docs.filter(~worded)))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
