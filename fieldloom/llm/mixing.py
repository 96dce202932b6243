"""Operator 8: mixes sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a
target stops at ``most_repeats`` times its source's size and the excess is shared again by weight.

Schedule: slot j of the mix is the point frac((j + 1/2) * golden ratio).  Points map through the
cumulative slot weights of the sources (target / block size), so any run of slots holds each source
nearly in proportion; the slots of a source are ranked, and slot r takes block r modulo the source's
number of blocks.  A source's documents, in the order of a hash, form one stream of words cut into
blocks of equal size: ``BLOCK_WORDS``, or less where a source's target is under ``LEAST_SLOTS`` such blocks.

The slots that the schedule draws decide what is taken.  Of the last drawn slot, and of one more slot after the
schedule's end, a source takes just as much as brings it closer to its target, so that what is taken differs
from the target by what the schedule's discrepancy exceeds one block.

Edge cases: null or empty texts have size 0 and are never taken; rows that repeat are documents of their own,
which take their turns one after another (rows equal in doc_id, source and text are numbered together, in one
task if one row is repeated very often); an empty table gives an empty mix.  Extra columns are kept by
``mix_documents`` and ignored by ``mix_counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import chunk_count, running_total
from .storage import materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fractional part in units of 2**-31.  (j * GOLDEN) modulo 2**31 is exact in 64 bits, alike on
#: every run, and visits each of the 2**31 points once before it starts again.
GOLDEN, POINT_BITS = 1327217885, 31
#: Cells (2**12, or sixteen a source) of the unit interval by which points find their source with an equality join.
CELL_BITS = 12
#: Words of a block, and how many slots a source has at least if its target allows.
BLOCK_WORDS, LEAST_SLOTS = 512, 256


def text_size(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, most_repeats: int = 3) -> DataFrame:
    """One row per source: its size, weight and target.

    A source is full if its limit per weight is below the share per weight that the sources with
    higher limits per weight get; over sources sorted by limit per weight, the full ones come first.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    limit = (F.lit(most_repeats) * F.col("source_size")).cast("double")
    rising = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    share = (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    sources = sources.withColumns({"_limit": limit, "_share": share, "_place": F.row_number().over(rising)})
    # the share at the first source that isn't full; sources may tie in their limit per weight
    first = F.min(F.when(F.col("_limit") / F.col("weight") >= F.col("_share"), F.struct("_place", "_share"))).over(Window.partitionBy())
    level = first["_share"]
    return sources.withColumn("target", F.when(level.isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), level * F.col("weight")))).drop("_limit", "_share", "_place")


def plan_sources(sized: DataFrame, block_words: int = BLOCK_WORDS, most_repeats: int = 3) -> DataFrame:
    """Targets with the sizes and numbers of blocks; ``goal`` is the target in whole words, ``most`` what may be taken."""
    sources = source_targets(sized, most_repeats)
    most = F.lit(most_repeats) * F.col("source_size")
    sources = sources.withColumn("most", most).withColumn("goal", F.least(F.round("target").cast("long"), most))
    wanted = F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("goal") / LEAST_SLOTS)))
    about = F.greatest(F.lit(1), F.ceil(F.col("source_size") / wanted))
    sources = sources.withColumn("block_size", F.greatest(F.lit(1), F.ceil(F.col("source_size") / about)).cast("long"))
    return sources.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_size")).cast("long"))


def drawn_slots(sources: DataFrame) -> tuple[DataFrame, int]:
    """(source, slot, slot_rank) of the slots of the mix, and how many there are."""
    spark, everywhere = sources.sparkSession, Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    wide = sources.filter("goal > 0").withColumn("_share", F.col("target") / F.col("block_size"))
    wide = wide.withColumn("_high", F.sum("_share").over(order)).withColumn("_all", F.sum("_share").over(everywhere))
    points = 1 << POINT_BITS
    wide = wide.withColumn("high", F.round(F.col("_high") / F.col("_all") * points).cast("long"))
    wide = wide.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0))).filter("high > low")
    n, n_sources = (int(x or 0) for x in wide.agg(F.ceil(F.max("_all")), F.count("*")).first())
    shift = POINT_BITS - min(POINT_BITS, max(CELL_BITS, n_sources.bit_length() + 4))
    intervals = wide.select("source", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    point = F.expr(f"(id & {points - 1}) * {GOLDEN}L & {points - 1}L")
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", shift))
    slots = slots.join(intervals, "cell").filter("point >= low AND point < high").select("source", "slot")
    slots = running_total(slots.withColumn("chunk", F.expr("slot >> 12")), ["source"], "chunk", [F.col("slot")], F.lit(1), "slot_rank")
    return slots.select("source", "slot", "slot_rank"), n


def schedule(sources: DataFrame) -> DataFrame:
    """The slots that give words, one row each: (slot, source, slot_rank, pass, block, upto).

    ``upto`` is the end of what the slot takes, in words of the source's stream; ``pass`` counts how often the
    stream was taken before.  A slot that closes a source after the schedule's end has the schedule's length.
    """
    slots, n = drawn_slots(sources)
    slots = materialize(slots)
    drawn = slots.groupBy("source").agg(F.count("*").alias("drawn")).withColumnRenamed("source", "_t")
    ends = sources.filter("source_size > 0").withColumnRenamed("source", "_s").join(drawn, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    ends = ends.withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    words = lambda r: F.floor(r / F.col("n_blocks")) * F.col("source_size") + F.least(r % F.col("n_blocks") * F.col("block_size"), F.col("source_size"))
    met = F.least(F.greatest("goal", words(F.greatest(F.col("drawn") - 1, F.lit(0)))), words(F.col("drawn") + 1), F.col("most"))
    ends = ends.withColumn("met", met).withColumn("tail", F.col("met") % F.col("source_size"))
    ends = ends.withColumn("n_slots", F.floor(F.col("met") / F.col("source_size")) * F.col("n_blocks") + F.ceil(F.col("tail") / F.col("block_size")))
    ends = ends.select("_s", "drawn", "n_slots", "n_blocks", "block_size", "source_size", "tail")
    kept = slots.join(ends, F.col("source").eqNullSafe(F.col("_s"))).filter("slot_rank < n_slots")
    closing = ends.filter("n_slots > drawn").select("*", F.col("_s").alias("source"), F.lit(n).cast("long").alias("slot"), F.col("drawn").alias("slot_rank"))
    out = kept.unionByName(closing.select(*kept.columns))
    out = out.withColumns({"block": F.col("slot_rank") % F.col("n_blocks"), "pass": F.floor(F.col("slot_rank") / F.col("n_blocks"))})
    end = F.least((F.col("block") + 1) * F.col("block_size"), F.col("source_size"))
    last = (F.col("slot_rank") == F.col("n_slots") - 1) & (F.col("tail") > 0)
    return out.select("slot", "source", "slot_rank", "pass", "block", F.when(last, F.least(end, F.col("tail"))).otherwise(end).alias("upto"))


ROW = ["doc_id", "source", "size", "code", "nr"]


def _number(df: DataFrame) -> DataFrame:
    """Adds ``_key`` (not null) and ``nr``: the number of a row among those equal in doc_id, source, size and code."""
    df = df.withColumn("_key", F.xxhash64("doc_id", "source", "size"))
    return df.withColumn("nr", F.row_number().over(Window.partitionBy("_key", "code").orderBy("doc_id")))


def stream_offsets(sized: DataFrame, rows: int) -> DataFrame:
    """Adds ``offset``: words of the source's documents before this one, in the order of a hash."""
    mixed = F.xxhash64("doc_id", "size", "code")
    chunk = F.pmod(mixed, F.lit(chunk_count(rows)))
    sized = sized.withColumn("_mixed", F.xxhash64(mixed)).withColumn("_chunk", chunk)
    return running_total(sized, ["source"], "_chunk", [F.col("_mixed"), *[F.col(c) for c in ROW if c != "source"]], F.col("size"), "offset").drop("_chunk", "_mixed")


def mix_passes(sized: DataFrame, block_words: int = BLOCK_WORDS, most_repeats: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each pass takes of each row of ``sized`` (doc_id, source, size, code): ROW, pass, words, slot.

    ``code`` tells different texts apart; ``slot`` is the pass' first slot that takes words of the row.  A pass
    takes a row's first words, all of them but in the stream's last pass.  Also returns all rows of ``sized`` with
    their numbers, and the plan of the sources.
    """
    sized = materialize(_number(sized.select("doc_id", "source", "size", "code")).select(*ROW))
    sources = materialize(plan_sources(sized, block_words, most_repeats))
    docs = stream_offsets(sized.filter("size > 0"), sized.count())
    docs = docs.join(sources.select(F.col("source").alias("_s"), "block_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    pieces = docs.withColumn("block", F.explode(F.expr("sequence(offset div block_size, (offset + size - 1) div block_size)")))
    slots = schedule(sources).drop("slot_rank").withColumnRenamed("source", "_u").withColumnRenamed("block", "_b")
    used = pieces.join(slots, F.col("source").eqNullSafe(F.col("_u")) & (F.col("block") == F.col("_b")))
    overlap = F.least(F.col("upto"), F.col("offset") + F.col("size")) - F.greatest(F.col("block") * F.col("block_size"), F.col("offset"))
    used = used.withColumn("words", overlap).filter("words > 0")
    return used.groupBy(*ROW, "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")), sized, sources


def mix_counts(sized: DataFrame, block_words: int = BLOCK_WORDS, most_repeats: int = 3) -> DataFrame:
    """How many words the mix takes of each row of ``sized`` (doc_id, source, size and, if there, code).

    Returns doc_id, source, size, source_size, target, taken, and first_slot (null if nothing is taken).
    """
    sized = sized if "code" in sized.columns else sized.withColumn("code", F.lit(0).cast("long"))
    passes, rows, sources = mix_passes(sized, block_words, most_repeats)
    every = passes.select(*ROW, "words", "slot").unionByName(rows.select(*ROW, F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("slot")))
    taken = every.groupBy(*ROW).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    about = sources.select(F.col("source").alias("_s"), "source_size", "target")
    return taken.join(about, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, most_repeats: int = 3, slot: str | None = None) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each pass in which a document is taken.

    A whole pass has the whole text; in a partial pass the text is cut to the words taken (n_chars, if
    there, follows).  Documents that the mix doesn't take go.  With ``slot``, a column of that name has each row's
    place in the mix: read in its order, the sources alternate as scheduled.
    """
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    about = [F.col(names["doc_id"]).alias("doc_id"), F.col(names["source"]).alias("source"), text_size(F.col(names["text"])).alias("size"), F.xxhash64(names["text"]).alias("code")]
    passes, _, _ = mix_passes(own.select(*about), block_words, most_repeats)
    passes = passes.select(F.xxhash64("doc_id", "source", "size").alias("_key"), "code", F.col("nr").alias("_n"), "pass", "words", "slot")
    own = _number(own.select("*", *about))
    # the texts are dealt once, for the numbers and the join: hence no key but those of the window
    joined = own.join(passes, (own["_key"] == passes["_key"]) & (own["code"] == passes["code"]) & (own["nr"] - passes["_n"] == 0))
    text = F.col(names["text"])
    space = F.regexp_extract(text, r"(?s)^[\x20\x09-\x0D]*", 0)
    part = F.concat(space, F.array_join(F.slice(F.split(F.substring(text, F.length(space) + 1, F.length(text)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, F.col("words").cast("int")), ""))
    joined = joined.withColumn(names["text"], F.when(F.col("words") == F.col("size"), text).otherwise(part))
    if "n_chars" in names:
        joined = joined.withColumn(names["n_chars"], F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()], *([F.col("slot").alias(slot)] if slot else []))


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = mix_counts(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("code")))
    return counts.select("doc_id", "size", "source_size", "target", "taken", "first_slot")
