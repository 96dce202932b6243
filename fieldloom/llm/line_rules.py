"""Operator 3 [native]: document rules and cross-document line frequency, in DataFrame functions only.

Base rules look at one text: words, symbols, repeated lines, words inside repeated 5-word windows.

Line frequency looks at all documents: each line, in lower case with single spaces, is hashed together
with its host (``source``); a line that more than ``LINE_LIMIT`` different documents of the host have is
boilerplate.  Exact copies are one document here (contents are counted, not rows), so a clean document
isn't lost for having copies.  A document is depleted, and rejected, if boilerplate lines hold more than
``DEPLETED`` of its words.

The text is read once; what the rules need of it (numbers and line hashes) is written and used from there.
Hot hosts and hot lines: counts combine before their shuffle, keyed by (line, content); the boilerplate
table is joined at whatever size it has, as Spark's size limit decides.

Edge cases: a null text has no words, lines or symbols, so base_failed is true; a null source is a host of
its own; rows that repeat are judged alike; an empty table gives no rows; extra columns are ignored
(``remove_lines`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import aside
from .storage import materialize

SPACES = r"[\x20\x09-\x0D]+"
LINE_LIMIT, DEPLETED = 25, 0.5
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def line_hash(line: Column, host: Column) -> Column:
    return F.xxhash64(F.coalesce(host, F.lit("\0")), F.lower(F.trim(F.regexp_replace(line, SPACES, " "))))


def document_numbers(docs: DataFrame) -> DataFrame:
    """Per row: the base numbers, the content's hash, and hash and words of each line that has a word."""
    docs = docs.select("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("words", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    docs = docs.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        F.xxhash64("text").alias("content"),
        F.transform("lines", lambda x: F.struct(line_hash(x, F.col("source")).alias("h"), F.size(words(x)).alias("n"))).alias("lines"),
    )
    docs = docs.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("ordered", lambda x, k: F.coalesce((x["h"] == F.get("ordered", k + 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get("ordered", k - 1)["h"], F.lit(False)))
    docs = docs.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("windows", "ordered")
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")


def frequent_lines(numbers: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """Hashes of the lines that more than ``limit`` different documents of a host have."""
    each = numbers.select("content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    return each.groupBy("h").agg(F.count_distinct("content").alias("n_docs")).filter(F.col("n_docs") > limit)


def judge(docs: DataFrame, limit: int = LINE_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """One row per document: its numbers, removed lines and words, base_failed and kept."""
    numbers = materialize(document_numbers(docs).withColumn("row", F.monotonically_increasing_id()))
    frequent = materialize(frequent_lines(numbers, limit))
    lines = numbers.select("row", F.explode("lines").alias("line")).select("row", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    removed = lines.join(frequent, "h").groupBy("row").agg(F.sum("n").alias("n_removed_words"), F.count("*").alias("n_removed_lines"))
    out = numbers.drop("lines", "content").join(removed, "row", "left").drop("row").na.fill(0, ["n_removed_words", "n_removed_lines"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_removed_words") <= depleted * F.col("n_words")))


def remove_lines(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """``docs`` with all boilerplate lines cut from the texts; all columns and rows stay."""
    docs, back = aside(docs, "doc_id", "text", "source")
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    docs = materialize(docs)
    frequent = materialize(frequent_lines(document_numbers(docs), limit))
    here = docs.select("_row", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: line_hash(x, F.col("source"))))).alias("h"))
    drop = here.join(frequent, "h").groupBy("_row").agg(F.collect_set("h").alias("_drop"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_drop", line_hash(x, F.col("source")))), "\n")
    return docs.join(drop, "_row", "left").withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept)).transform(back)


def op3_query(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")
