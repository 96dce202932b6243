"""Operator 5: near-duplicate paragraphs across documents, by MinHash banding.

Paragraphs are cut by content, so that a passage is cut alike wherever it stands, but for its first sentences.  Units
are sentences and ends of lines.  A long unit (``MIN_WORDS`` words; a word without spaces inside, as in Chinese, counts
by its bytes) ends a paragraph.  Short units gather until they have ``FEW_WORDS`` words and the last word of a unit says so, or they
have enough words and a long one follows, whatever lines they stand in: verse, lists and wrapped lines are cut where
their words are.
In lower case and with single spaces paragraphs are hashed; equal ones are one class.

Classes are banded by MinHash over shingles of five words: ``ROWS`` values a band, and as many bands as bring a pair
of Jaccard similarity 0.75 together with probability ``RECALL`` (``bands_for``).  Classes that collide in a band are
paired with the bucket's first and with their predecessor, verified by exact Jaccard similarity of their shingle sets,
and clustered by connected components.  Buckets that still hold several components are then compared whole: all their
pairs of different components, in blocks of ``BLOCK`` by ``BLOCK`` classes.  So each pair that collides in a band is
verified or connected already.

Of each cluster that spans documents, the paragraph with the smallest (doc_id, number) stays.  Others are
repeats; they are removed where consecutive repeats of a document have ``MIN_RUN`` words or more, so that
single stock sentences stay.

Skew: equal paragraphs collapse before banding; classes carry their smallest place, so no task gets all
copies; the places of classes that have more than a thousandth of all places (at most a thousand classes) find their
cluster by broadcast; messages are packed by shard; a large bucket's blocks are dealt over all tasks (their number grows with the
square of the components that share a bucket, as all their pairs count).

Edge cases: null and empty texts have no paragraphs; short units that nothing gathers (alone between a line's end and
a long unit, or at the end of a text) take no part; rows with a null doc_id take no part; rows that repeat a doc_id count as one
document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .graph import components
from .idfilter import id_filter, only_wanted
from .shingles import shingle_sets
from .columns import aside
from .storage import materialize, shuffle_partitions

MIN_WORDS, MIN_RUN, PERCENT = 8, 25, 75
#: Words from which a word may end gathered short units, words at which they end in any case, and bytes that count as a word inside a longer one.
FEW_WORDS, MOST_WORDS, WORD_BYTES = 5, 32, 12


def bands_for(rows: int, recall: float, similarity: float = PERCENT / 100) -> int:
    """How many bands of so many values bring a pair of that similarity together with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


ROWS, RECALL = 3, 0.99
BANDS = bands_for(ROWS, RECALL)
#: A class is hot if it has more than this part of all places; so there are fewer hot classes than this.
HOT_SHARE = 1000
#: Classes that a task remembers to have sent, about.
REMEMBERED = 1 << 18
#: Classes on each side of a block of pairs; sets that are sent to a task at once, about.
BLOCK, PACKED = 256, 1 << 12
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)
_PLACE = "doc_id long, code long, number int, start int, end int, words int, class long"


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number, first byte, byte after the last and words of each paragraph.

    Sentences end at ``.``, ``!`` or ``?`` before white space; lines end at a newline.
    """
    starts, ends, rows = tb.word_spans(data, offsets)
    n = len(starts)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    newline = np.concatenate(([0], np.cumsum(data == 10)))
    row_end, line_end = np.ones(n, bool), np.ones(n, bool)
    row_end[:-1] = rows[1:] != rows[:-1]
    line_end[:-1] = row_end[:-1] | (newline[starts[1:]] != newline[ends[:-1]])
    stops = np.flatnonzero(line_end | np.isin(data[ends - 1], [0x2E, 0x21, 0x3F]))
    weight = np.concatenate(([0], np.cumsum(np.maximum(1, (ends - starts) // WORD_BYTES))))
    upto = weight[stops + 1]
    long = np.diff(upto, prepend=0) >= MIN_WORDS
    before_long = np.append(long[1:], True) | row_end[stops]
    # a property of a unit's last word, by which about half of the short units may end a paragraph
    says = (tb.LOWER[data[starts[stops]]] + ends[stops] - starts[stops]) % 2 == 0
    least = np.where(says, FEW_WORDS, np.where(long | before_long, MIN_WORDS, MOST_WORDS))
    forget = row_end[stops] | (line_end[stops] & before_long)
    first, last, begin, base = [], [], 0, 0
    for k, total, enough, drops in zip(stops.tolist(), upto.tolist(), least.tolist(), forget.tolist()):
        if total - base >= enough:
            first.append(begin)
            last.append(k)
            begin, base = k + 1, total
        elif drops:
            begin, base = k + 1, total
    first, last = np.array(first, np.int64), np.array(last, np.int64)
    row = rows[first]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    return row, number, starts[first], ends[last], upto[np.searchsorted(stops, last)] - weight[first]


def classes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class (hash of the words in lower case) of each span, and shingle sets of the spans."""
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size)))
    text = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    low = tb.LOWER[text]
    w_start, w_end, w_row = tb.word_spans(low, at)
    words = tb.span_hashes(low, w_start, w_end)
    # a class is the sum of its words' hashes, mixed with their places
    place = np.arange(len(words)) - np.searchsorted(w_row, w_row)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix(words + _STEP * place.astype(np.uint64)))))
    bounds = np.searchsorted(w_row, np.arange(len(size) + 1))
    code = tb.mix(sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64)
    return code, *shingle_sets(text, at)


def band_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of all bands (columns) of each shingle set; sets aren't empty."""
    least = [np.minimum.reduceat(tb.mix(h ^ s), at[:-1]) for s in _SEEDS]
    keys = []
    for b in range(BANDS):
        k = np.full(len(at) - 1, b, np.uint64)
        for v in least[b * ROWS : (b + 1) * ROWS]:
            k = tb.mix(k * _STEP + v)
        keys.append(k)
    return np.stack(keys, axis=1)


def places(docs: DataFrame) -> DataFrame:
    """All paragraphs with enough words: where they stand and their class; ``code`` is a hash of the whole text."""
    docs = docs if "code" in docs.columns else docs.withColumn("code", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("code").to_numpy()
            for low, high in tb.slices(offsets, 1 << 19):
                base = offsets[low]
                part = data[base : offsets[high]]
                row, number, start, end, words = cut(part, offsets[low : high + 1] - base)
                if not len(row):
                    continue
                code = classes_of(part, start, end)[0]
                inner = offsets[low:high][row] - base
                columns = [pa.array(ids[low + row]), pa.array(texts[low + row]), *[pa.array((x).astype(np.int32)) for x in (number, start - inner, end - inner, words)], pa.array(code)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "code", "number", "start", "end", "words", "class"])

    return docs.mapInArrow(work, _PLACE)


def band_messages(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, packed): band keys with class, packed by shard; each class once a task."""
    entry = np.dtype([("key", "<u8"), ("class", "<i8")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for low, high in tb.slices(offsets, 1 << 19):
                base = offsets[low]
                part = data[base : offsets[high]]
                _, _, start, end, _ = cut(part, offsets[low : high + 1] - base)
                if not len(start):
                    continue
                code, h, at = classes_of(part, start, end)
                once = np.array([c not in sent and not sent.add(c) for c in code.tolist()], bool)
                if len(sent) > REMEMBERED:  # forgetting only sends a class again
                    sent.clear()
                if not once.any():
                    continue
                keys = band_keys(h, at)[once]
                out = np.empty(keys.size, entry)
                out["key"], out["class"] = keys.reshape(-1), np.repeat(code[once], BANDS)
                shard = (out["key"] & np.uint64(0xFFFFFFFF)).astype(np.int64) * shards >> 32
                by = np.argsort(shard, kind="stable")
                out, shard = out[by], shard[by]
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                stops = np.append(cuts[1:], len(out))
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts], pa.int32()), pa.array([out["key"][a:b].tobytes() + out["class"][a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary())], names=["shard", "packed"])

    return docs.select("text").mapInArrow(work, "shard int, packed binary")


def candidates(messages: DataFrame) -> DataFrame:
    """Pairs (a, b, null) of classes that collide in a band: with the bucket's first class, and with the one before.

    Buckets with more pairs than these are listed by member as (class, null, key).
    """

    def meet(table: pa.Table) -> pa.Table:
        raw = table.column("packed").to_pylist()
        key = np.concatenate([np.frombuffer(x, "<u8", len(x) // 16) for x in raw])
        code = np.concatenate([np.frombuffer(x, "<i8", len(x) // 16, len(x) // 2) for x in raw])
        order = np.lexsort((code, key))
        key, code = key[order], code[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
        key, code = key[new], code[new]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        head = np.searchsorted(key, key[same])
        pairs = np.unique(np.stack([np.concatenate((code[head], code[same - 1])), np.concatenate((code[same], code[same]))]), axis=1)
        # the first and the predecessor are all pairs of up to three classes
        more = np.searchsorted(key, key, "right") - np.searchsorted(key, key) > 3
        none = lambda n: pa.nulls(n, pa.int64())
        b = pa.chunked_array([pa.array(pairs[1]), none(int(more.sum()))])
        keys = pa.chunked_array([none(pairs.shape[1]), pa.array(key[more].astype(np.int64))])
        return pa.table({"a": pa.array(np.concatenate((pairs[0], code[more]))), "b": b, "key": keys})

    return messages.groupBy("shard").applyInArrow(meet, "a long, b long, key long")


def class_sets(docs: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the wanted classes, from the texts of one place of each.

    Texts without a wanted class mostly (as a filter of fixed size tells) stay in their tasks.
    """
    spots = known.join(wanted, "class").select(F.col("p.doc_id").alias("_d"), "class")
    by_doc = materialize(spots.groupBy("_d").agg(F.collect_set("class").alias("classes")))
    texts = only_wanted(docs, id_filter(by_doc.select("_d"))).join(by_doc, F.col("doc_id") == F.col("_d")).select("text", "classes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for k, wanted in enumerate(batch.column("classes").to_pylist()):
                part = data[offsets[k] : offsets[k + 1]]
                _, _, start, end, _ = cut(part, np.array([0, len(part)]))
                code, h, at = classes_of(part, start, end) if len(start) else (np.zeros(0, np.int64), None, None)
                found = np.unique(code, return_index=True)[1]
                found = found[np.isin(code[found], wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(code[found]), pa.array([h[at[i] : at[i + 1]].astype(np.int64) for i in found], pa.list_(pa.int64()))], names=["class", "shingles"])

    # documents share an id only where rows repeat it: one set per class
    return materialize(texts.mapInArrow(sets, "class long, shingles array<long>").groupBy("class").agg(F.min("shingles").alias("shingles")))


def verify(docs: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets reach the threshold."""
    each = class_sets(docs, known, pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct())
    side = lambda x: each.select(F.col("class").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.size(F.array_intersect("s_a", "s_b")))
    return both.filter(100 * F.col("n") >= PERCENT * (F.size("s_a") + F.size("s_b") - F.col("n"))).select("a", "b")


def open_blocks(members: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """(key, i, j, class, component): the classes of each block of pairs that has different components.

    A bucket's classes, ordered by component, are cut into groups; blocks are the pairs of its groups.
    """
    rows = members.join(found.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    several = rows.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b").select("key")
    rows = rows.join(several, "key").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def number(table: pa.Table) -> pa.Table:
        key, code, component = (table.column(x).to_numpy() for x in ("key", "class", "component"))
        order = np.lexsort((code, component, key))
        key = key[order]
        group = (np.arange(len(key)) - np.searchsorted(key, key)) // BLOCK
        return pa.table({"key": key, "class": code[order], "component": component[order], "g": group.astype(np.int32)})

    rows = materialize(rows.groupBy("shard").applyInArrow(number, "key long, class long, component long, g int"))
    groups = rows.groupBy("key", "g").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = groups.select("key", F.col("g").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    blocks = left.join(groups.withColumnRenamed("g", "j"), "key").filter("i <= j AND (low_i <> high OR high_i <> low)")
    blocks = blocks.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("g"))
    return blocks.join(rows, ["key", "g"]).select("key", "i", "j", "g", "class", "component")


def _links_of_block(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of different components, as indices: left ones with the others, or all pairs if all are left."""
    size = np.array([len(x) for x in sets])
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), count[name] > 1
    row, name = row[shared], (np.cumsum(count > 1) - 1)[name[shared]]
    rows, columns = np.flatnonzero(left), np.flatnonzero(left if left.all() else ~left)
    both = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    for low in range(0, int(count[count > 1].size), 1 << 13):
        here = slice(*np.searchsorted(name, [low, low + (1 << 13)]))
        has = np.zeros((len(sets), int(name[here].max()) - low + 1), np.float32)
        has[row[here], name[here] - low] = 1
        both += has[rows] @ has[columns].T
    both = both.astype(np.int64)
    good = 100 * both >= PERCENT * (size[rows][:, None] + size[columns] - both)
    i, j = np.nonzero(good & (component[rows][:, None] != component[columns]))
    return rows[i], columns[j]


def links_in_blocks(blocks: DataFrame, each: DataFrame) -> DataFrame:
    """All similar pairs (a, b) of different components in the blocks, from the classes' sets; many blocks a task."""
    packs = max(shuffle_partitions(blocks.sparkSession), blocks.count() // PACKED)

    def work(table: pa.Table) -> pa.Table:
        key, i, j, g, code, component = (table.column(x).to_numpy() for x in ("key", "i", "j", "g", "class", "component"))
        shingles = table.column("shingles").combine_chunks()
        values, at = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        order = np.lexsort((code, g, j, i, key))
        apart = np.zeros(len(order) - 1, bool)
        for x in (key, i, j):
            apart |= np.diff(x[order]) != 0
        out = []
        for here in np.split(order, np.flatnonzero(apart) + 1):
            a, b = _links_of_block([values[at[k] : at[k + 1]] for k in here], component[here], g[here] == i[here])
            out.append(np.stack([code[here[a]], code[here[b]]]))
        pairs = np.concatenate(out, axis=1)
        pairs = np.unique(np.stack([pairs.min(axis=0), pairs.max(axis=0)]), axis=1)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    sent = blocks.join(each, "class").withColumn("pack", F.pmod(F.xxhash64("key", "i", "j"), F.lit(packs)).cast("int"))
    return sent.groupBy("pack").applyInArrow(work, "a long, b long")


def linked_classes(docs: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """(node, component) of all classes that collide in a band and are similar."""
    met = materialize(candidates(band_messages(docs, shards)))
    links = materialize(verify(docs, known, met.filter("key is null").select("a", "b").distinct()))
    found = materialize(components(links))
    blocks = materialize(open_blocks(met.filter("key is not null").select("key", F.col("a").alias("class")), found, shards))
    if blocks.isEmpty():
        return found
    more = links_in_blocks(blocks, class_sets(docs, known, blocks.select("class").distinct()))
    return components(links.unionByName(more))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """One row per paragraph of a cluster that spans documents.

    doc_id, number (among the document's paragraphs), start and end (bytes of the text), words, first_doc and
    first_number (the cluster's paragraph that stays), removed.
    """
    return clustered_paragraphs(docs).drop("code")


def clustered_paragraphs(docs: DataFrame) -> DataFrame:
    """The same, and ``code``, which tells the texts of rows that share a doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("code")).filter("doc_id is not null and text is not null")
    own = materialize(places(docs))
    total = own.count()
    shards = max(shuffle_partitions(docs.sparkSession), total * BANDS >> 18)
    # each class' smallest place, last document and number of places, combined before the shuffle
    known = materialize(own.groupBy("class").agg(F.min(F.struct("doc_id", "number")).alias("p"), F.max("doc_id").alias("last"), F.count("*").alias("n")))
    links = linked_classes(docs, known, shards).select(F.col("node").alias("class"), "component")
    placed = known.join(links, "class", "left").withColumn("component", F.coalesce("component", "class"))
    whole = placed.groupBy("component").agg(F.min("p").alias("q"), F.max("last").alias("last")).filter(F.col("q.doc_id") < F.col("last"))
    stays = materialize(placed.join(whole.select("component", "q"), "component").select("class", "n", F.col("q.doc_id").alias("first_doc"), F.col("q.number").alias("first_number")))
    many = F.col("n") > total / HOT_SHARE  # true of fewer than HOT_SHARE classes
    hot = F.broadcast(stays.filter(many).drop("n"))
    rest = own.join(F.broadcast(stays.filter(many).select("class")), "class", "left_anti").join(stays.filter(~many).drop("n"), "class")
    out = own.join(hot, "class").unionByName(rest).drop("class").distinct()
    out = out.withColumn("repeat", (F.col("doc_id") != F.col("first_doc")) | (F.col("number") != F.col("first_number")))
    mine = Window.partitionBy("doc_id", "code").orderBy("number", "start")
    gap = F.coalesce((F.col("number") != F.lag("number").over(mine) + 1) | ~F.lag("repeat").over(mine) | ~F.col("repeat"), F.lit(True))
    out = out.withColumn("run", F.sum(gap.cast("int")).over(mine))
    run = F.sum(F.when(F.col("repeat"), F.col("words")).otherwise(0)).over(Window.partitionBy("doc_id", "code", "run"))
    return out.withColumn("removed", F.col("repeat") & (run >= MIN_RUN)).select("doc_id", "code", "number", "start", "end", "words", "first_doc", "first_number", "removed")


def remove_paragraphs(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed paragraphs; all columns and rows stay.  Rows that share a doc_id lose what their own texts repeat."""
    docs, back = aside(docs, "doc_id", "text")
    gone = clustered_paragraphs(docs).filter("removed").groupBy(F.col("doc_id").alias("_d"), F.col("code").alias("_t")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_gone"))
    names = docs.columns
    joined = docs.join(materialize(gone), (F.col("doc_id") == F.col("_d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_t")), "left").drop("_d", "_t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist()):
                raw = (text or "").encode()
                for r in reversed(ranges or []):
                    raw = raw[: r["start"]] + raw[r["end"] :]
                texts.append(None if text is None else raw.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return back(joined.mapInArrow(work, docs.schema))


def op5_query(spark, sf_dir: str) -> DataFrame:
    """The removed paragraphs of all documents, and what they repeat."""
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("removed").drop("removed")
