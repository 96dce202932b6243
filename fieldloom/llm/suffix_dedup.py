"""Operator 1: exact substring deduplication by suffix arrays over shards.

A byte of a text goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller
doc_id.  Suffixes of a whole corpus can't meet in one place, so they are dealt to shards such that equal
strings of SPAN bytes always meet, and only those that can have an equal:

1. Anchors.  Each window of SPAN bytes has one anchor, its grams' (``GRAM`` bytes) minimum by hash; equal
   windows have equal anchors.  Blocks of documents send the hashes of their anchors to shards, which reply
   with those that another document has too.
2. Runs.  Consecutive windows with one anchor are a run.  Blocks send the text of the runs whose anchor is
   shared to the anchor's shard, each different text once, with all places where it stands.
3. Suffix arrays.  A shard takes its texts in parts of bounded size, again by their anchors, joins each part's into
   one string and sorts its suffixes by induced sorting.
   Permuted common prefixes of SPAN bytes tell which suffixes begin alike, and the smallest doc_id among those
   decides which windows go.  Shards reply with byte ranges, and blocks cut them.

Skew: blocks are dealt by hashes of doc_id; exact copies of a smaller document are found first (by counts of
content hashes), go whole and take no part; a block sends repeated text once; an anchor that very many blocks
share is dealt on by single windows.  Blocks, shards and parts have bounded sizes, so memory doesn't grow with the
corpus.

Strings are told apart by 64-bit hashes of their bytes (as sums of powers, mixed), which isn't proof against texts made
to collide.  Edge cases: null texts are empty; texts under SPAN bytes keep all bytes; a null doc_id counts as larger than
all others; rows that repeat (doc_id and text) don't remove each other; texts that share a doc_id don't
either; an empty table gives no rows; extra columns are kept by ``remove_repeats``.  Cut texts are decoded
without the bytes of characters that were cut in two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .columns import aside
from .storage import materialize, shuffle_partitions
from .suffixes import common_with_previous, suffix_array

SPAN, GRAM = 50, 20
#: Bytes of text of a block and of a shard, about.
BLOCK_BYTES, SHARD_BYTES = 3 << 20, 8 << 20
#: Bytes of different texts that a shard sorts at once, about; the sorting takes some 30 bytes of memory for each.
PART_BYTES = 1 << 20
#: Blocks that share an anchor before its windows are dealt one by one.
HOT_BLOCKS = 2000
LAST = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first byte, byte after the last, and row of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.astype(np.uint64), none, none, none
    up, down = tb.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tb.SYMBOLS[data] * up[: len(data)], out=sums[1:])
    grams = tb.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, wanted = 1, SPAN - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & _LOW).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside[max(start, end - SPAN + 1) : end] = False
    at = np.flatnonzero(inside)
    anchor = anchor[at]
    new = np.diff(anchor, prepend=-1) != 0
    first = np.flatnonzero(new)
    start = at[first]
    end = at[np.append(first[1:], len(at)) - 1] + SPAN if len(first) else start
    return grams[anchor[first]], start, end, np.searchsorted(offsets, start, "right") - 1


class Block:
    """The different rows of a block in the order of (doc_id, content), and which of them are copies."""

    def __init__(self, docs: pa.Table, right: pa.Table):
        self.docs = docs
        ids = [LAST if x is None else x for x in docs.column("doc_id").to_pylist()]
        contents = docs.column("_content").to_pylist()
        gone = {(LAST if d is None else d, c) for d, c in zip(right.column("doc_id").to_pylist(), right.column("_content").to_pylist()) if c is not None}
        keys = sorted(set(zip(ids, contents)))
        rank = {k: n for n, k in enumerate(keys)}
        self.row = np.array([rank[k] for k in zip(ids, contents)], np.int64)  # of each input row
        self.ids = np.array([d for d, _ in keys], np.int64)
        self.copy = np.array([k in gone for k in keys], bool)
        first = np.zeros(len(keys), np.int64)
        first[self.row[::-1]] = np.arange(len(ids))[::-1]
        text = docs.column("text").cast(pa.large_binary()).combine_chunks() if docs.num_rows else pa.array([], pa.large_binary())
        self.data, self.offsets = tb.text_bytes(text.take(pa.array(first)))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of all rows that aren't copies: anchor, start and end in the block's bytes, row."""
        parts = [[], [], [], []]
        for low, high in tb.slices(self.offsets, 1 << 19):
            base = self.offsets[low]
            g, start, end, row = window_runs(self.data[base : self.offsets[high]], self.offsets[low : high + 1] - base)
            keep = ~self.copy[row + low]
            for part, x in zip(parts, (g[keep], start[keep] + base, end[keep] + base, row[keep] + low)):
                part.append(x)
        return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h & _LOW) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _part(h: np.ndarray) -> np.ndarray:
    """Of a shard's 256 parts; the lowest bits, which choose neither the anchor nor the shard."""
    return (h & np.uint64(0xFF)).astype(np.uint8)


def _short(h: np.ndarray) -> np.ndarray:
    """The upper 48 bits; the lower ones choose the shard."""
    return h >> np.uint64(16)


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _once(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, sorted, and whether several rows have each."""
    order = np.lexsort((row, g))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, count = np.unique(g[new], return_counts=True)
    return g, count > 1


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, first, after) of each run of equal keys."""
    first = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return list(zip(sorted_keys[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_keys)).tolist()))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


_ASKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("single", pa.binary()), ("several", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())])
_RUNS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *[(x, pa.binary()) for x in ("lengths", "texts", "parts", "counts", "ids", "rows", "starts")]])
_RANGES = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def ask(docs: pa.Table, right: pa.Table, shards: int) -> pa.Table:
    """Step 1, block: hashes of anchors by shard, those of one row and those of several apart."""
    out = []
    if docs.num_rows:
        g, _, _, row = Block(docs, right).runs()
        g, several = _once(g, row)
        shard = _shard(g, shards)
        order = np.argsort(shard, kind="stable")
        g, several, shard = _short(g[order]), several[order], shard[order]
        block = docs.column("_block")[0].as_py()
        out = [(s, block, _pack48(g[a:b][~several[a:b]]), _pack48(g[a:b][several[a:b]])) for s, a, b in _cuts(shard)]
    return _table(_ASKS, out)


def reply(table: pa.Table, hot_blocks: int) -> pa.Table:
    """Step 1, shard: to each block the hashes that other rows have too, and those that very many blocks have."""
    singles = [_unpack48(x) for x in table.column("single").to_pylist()]
    several = [_unpack48(x) for x in table.column("several").to_pylist()]
    # all blocks' hashes are looked up at once: to go through a shard's hashes for each block takes blocks x shards x their size
    every = np.concatenate(singles + several)
    g, which, count = np.unique(every, return_inverse=True, return_counts=True)
    bounds = np.cumsum([0] + [len(x) for x in singles + several])
    shared, hot = count > 1, count > hot_blocks
    shared[which[bounds[len(singles)] :]] = True
    shared, hot = shared[which], hot[which] if hot.any() else None
    out = []
    for k, block in enumerate(table.column("block").to_pylist()):
        mine, more = (slice(bounds[n], bounds[n + 1]) for n in (k, len(singles) + k))
        own = every[mine][shared[mine]]
        warm = own[:0] if hot is None else np.concatenate([every[x][hot[x]] for x in (mine, more)])
        if len(own) or len(warm):
            out.append((block, _pack48(own), _pack48(warm)))
    return _table(_REPLY, out)


def send_runs(docs: pa.Table, right: pa.Table, shards: int) -> pa.Table:
    """Step 2, block: texts of runs with a shared anchor, by shard, each different text once with its places."""
    if not docs.num_rows:
        return _table(_RUNS, [])
    block = Block(docs, right)
    g, start, end, row = block.runs()
    own, several = _once(g, row)
    read = lambda name: np.unique(np.concatenate([_unpack48(x) for x in right.column(name).to_pylist() if x is not None] or [np.zeros(0, "<u8")]))
    shared, hot = np.union1d(read("shared"), _short(own[several])), read("hot")
    keep = np.isin(_short(g), shared)
    g, start, end, row = g[keep], start[keep], end[keep], row[keep]
    if len(hot):
        warm = np.isin(_short(g), hot)
        n = np.where(warm, end - start - SPAN + 1, 1)
        start = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        end, row, g, warm = np.where(np.repeat(warm, n), start + SPAN, np.repeat(end, n)), np.repeat(row, n), np.repeat(g, n), np.repeat(warm, n)
    text = np.zeros(len(g), np.uint64)
    for low, high in tb.slices(block.offsets, 1 << 20):
        some = (row >= low) & (row < high)
        base = block.offsets[low]
        text[some] = tb.span_hashes(block.data[base : block.offsets[high]], start[some] - base, end[some] - base)
    if len(hot):
        g = np.where(warm, text, g)
    shard = _shard(g, shards)
    order = np.lexsort((block.ids[row] if len(row) else row, text, shard))
    shard, g, text, start, end, row = shard[order], g[order], text[order], start[order], end[order], row[order]
    raw, number, out = block.data, docs.column("_block")[0].as_py(), []
    for s, a, b in _cuts(shard):
        first = np.flatnonzero(np.diff(text[a:b], prepend=text[a : a + 1] + np.uint64(1))) + a
        counts = np.diff(np.append(first, b))
        size = end[first] - start[first]
        source = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        packed = (size.astype("<i4"), raw[source], _part(g[first]), counts.astype("<i4"), block.ids[row[a:b]].astype("<i8"), row[a:b].astype("<i4"), (start[a:b] - block.offsets[row[a:b]]).astype("<i4"))
        out.append((s, number, *[x.tobytes() for x in packed]))
    return _table(_RUNS, out)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, n of them."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def earliest(data: np.ndarray, start: np.ndarray, size: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts, by where they start in ``data``: places in one string, and by place the smallest doc_id that has the window there.

    ``lowest``: the smallest doc_id that has each text.
    """
    # one string: the texts, each followed by a separator below all bytes
    at = np.cumsum(size + 1) - size - 1
    joined = np.zeros(int((size + 1).sum()), np.int16)
    joined[_spread(at, size)] = data[_spread(start, size)].astype(np.int16) + 1
    order = suffix_array(joined)
    inside = np.zeros(len(joined), bool)
    inside[_spread(at, size - SPAN + 1)] = True
    order = order[inside[order]]
    alike = common_with_previous(np.maximum(joined - 1, 0).astype(np.uint8), order, SPAN)
    alike[:1] = False
    owner = np.repeat(lowest, size + 1)
    out = np.zeros(len(joined), np.int64)
    out[order] = np.minimum.reduceat(owner[order], np.flatnonzero(~alike))[np.cumsum(~alike) - 1]
    return at, out


def resolve(table: pa.Table) -> pa.Table:
    """Step 3, shard: the byte ranges that go, for each block."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    lengths, texts, parts, counts, ids, rows, starts = (get(n, k) for n, k in (("lengths", "<i4"), ("texts", np.uint8), ("parts", np.uint8), ("counts", "<i4"), ("ids", "<i8"), ("rows", "<i4"), ("starts", "<i4")))
    sizes = np.concatenate(lengths).astype(np.int64)
    data = np.concatenate(texts)
    del texts
    bounds = np.append(0, np.cumsum(sizes))
    h = np.zeros(len(sizes), np.uint64)
    for low, high in tb.slices(bounds, 1 << 20):
        base = bounds[low]
        h[low:high] = tb.span_hashes(data[base : bounds[high]], bounds[low:high] - base, bounds[low + 1 : high + 1] - base)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    place_text = np.repeat(which, np.concatenate(counts))  # the different text of each place
    place_id = np.concatenate(ids)
    lowest = np.full(len(first), LAST, np.int64)
    np.minimum.at(lowest, place_text, place_id)
    del h, which, counts, ids

    # parts of the shard, as many at once as make up a string of some size; equal windows are in one part
    part, size, source = np.concatenate(parts)[first], sizes[first], bounds[:-1][first]
    out = []
    for least, after in tb.slices(np.append(0, np.cumsum(np.bincount(part, size, 256).astype(np.int64))), PART_BYTES):
        mine = (part >= least) & (part < after)
        if not mine.any():
            continue
        at = np.zeros(len(size), np.int64)
        at[mine], ids = earliest(data, source[mine], size[mine], lowest[mine])
        # windows of all places; those go whose string starts in a smaller document
        places = np.flatnonzero(mine[place_text])
        windows = size[place_text[places]] - SPAN + 1
        for low, high in tb.slices(np.append(0, np.cumsum(windows)), 1 << 19):
            own, k = places[low:high], windows[low:high]
            offset = _spread(np.zeros(len(k), np.int64), k)
            goes = ids[_spread(at[place_text[own]], k)] < np.repeat(place_id[own], k)
            head = goes & ((offset == 0) | ~np.concatenate(([False], goes[:-1])))
            tail = goes & np.concatenate((~goes[1:] | (offset[1:] == 0), [True]))
            out.append((np.repeat(own, k)[head], offset[head], offset[tail] + SPAN))
    place, start, end = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(place, kind="stable")
    place, start, end = place[order], start[order], end[order]
    block = np.repeat(np.arange(len(rows)), [len(x) for x in rows])[place]
    row, base = np.concatenate(rows)[place], np.concatenate(starts)[place]
    blocks = table.column("block").to_pylist()
    return _table(_RANGES, [(blocks[b], row[a:z].astype("<i4").tobytes(), (base[a:z] + start[a:z]).astype("<i4").tobytes(), (base[a:z] + end[a:z]).astype("<i4").tobytes()) for b, a, z in _cuts(block)])


def cut(docs: pa.Table, right: pa.Table, columns: list[str], with_text: bool) -> pa.Table:
    """Step 4, block: the rows with their numbers and, if asked for, what is left of their texts."""
    block = Block(docs, right)
    data, offsets = block.data, block.offsets
    change = np.zeros(len(data) + 1, np.int32)
    for r, s, e in zip(*[right.column(x).to_pylist() for x in ("rows", "starts", "ends")]):
        if r is not None:
            base = offsets[np.frombuffer(r, "<i4")]
            np.add.at(change, base + np.frombuffer(s, "<i4"), 1)
            np.add.at(change, base + np.frombuffer(e, "<i4"), -1)
    gone = np.cumsum(change[:-1]) > 0
    size = np.diff(offsets)
    gone |= np.repeat(block.copy & (size >= SPAN), size)
    before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
    before[offsets[:-1][size > 0]] = False
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    removed, spans = total(gone), total(gone & ~before)
    left = data[~gone].tobytes()
    at = offsets - np.concatenate(([0], np.cumsum(removed)))
    kept = [left[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    r = block.row
    out = {c: docs.column(c) for c in columns if c != "text" or not with_text}
    if with_text and "text" in columns:
        null = docs.column("text").is_null().to_pylist()
        out["text"] = pa.array([None if n else kept[k].decode("utf-8", "ignore") for n, k in zip(null, r)], pa.string())
    out |= {"n_bytes": pa.array(size[r]), "n_removed": pa.array(removed[r]), "n_spans": pa.array(spans[r]), "kept_sha256": pa.array([hashlib.sha256(kept[k]).hexdigest() for k in r], pa.string())}
    return pa.table({c: out[c] for c in [*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]})


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with repeated strings cut from the texts, and n_bytes, n_removed, n_spans, kept_sha256.

    Columns of those names are replaced.  Without ``with_text`` texts are dropped and not sent back.
    """
    spark, (docs, back) = docs.sparkSession, aside(docs, "doc_id", "text")
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    columns = [c for c in docs.columns if with_text or c != "text"]
    fields = [f for f in docs.schema.fields if f.name in columns]
    content = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    own = F.coalesce("doc_id", F.lit(LAST))
    digest = docs.select(own.alias("id"), content.alias("_content"), F.octet_length("text").alias("n"))
    first = digest.groupBy("_content").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.count("*").alias("rows"))
    first = materialize(first)
    total = first.agg(F.sum("n")).first()[0] or 0
    partitions = shuffle_partitions(spark)
    # each block sends a message to each shard: no more of both than the data's size or an even load asks for
    blocks, shards = max(3 * partitions, total // BLOCK_BYTES), max(partitions, total // SHARD_BYTES)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    copies = digest.join(first.filter("rows > 1").select("_content", "first"), "_content").filter("id > first").select("id", "_content").distinct()
    copies = materialize(copies.withColumn("doc_id", F.when(F.col("id") < LAST, F.col("id"))).select(block.alias("_block"), "doc_id", "_content"))
    texts = docs.withColumns({"_block": block, "_content": content})

    def beside(messages: DataFrame | None, names: list[str]) -> DataFrame:
        """Copies and, for the same blocks, the messages of the step before."""
        if messages is None:
            return copies
        return copies.select("*", *[F.lit(None).cast("binary").alias(n) for n in names]).unionByName(
            messages.select(F.col("block").alias("_block"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("_content"), *names))

    def at_blocks(right: DataFrame, work, schema) -> DataFrame:
        return texts.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(work, schema)

    hot_blocks = HOT_BLOCKS
    asks = at_blocks(beside(None, []), lambda a, b: ask(a, b, shards), _ddl(_ASKS))
    replies = asks.groupBy("shard").applyInArrow(lambda t: reply(t, hot_blocks), _ddl(_REPLY))
    runs = at_blocks(beside(replies, ["shared", "hot"]), lambda a, b: send_runs(a, b, shards), _ddl(_RUNS))
    ranges = runs.groupBy("shard").applyInArrow(resolve, _ddl(_RANGES))
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    out = at_blocks(beside(ranges, ["rows", "starts", "ends"]), lambda a, b: cut(a, b, columns, with_text), T.StructType(fields + added))
    return back(out if with_text else out.withColumn("text", F.lit(None).cast("string")), *[f.name for f in added]).drop(*([] if with_text else ["text"]))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text"), with_text=False)
