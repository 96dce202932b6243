"""Corpus pipeline: five training-data operators, one after another, over the documents.

Each stage takes what its predecessor kept.  All stages but the last return the columns of documents.

Edge cases, in all stages: null and empty texts are documents (the classifier scores them; they are similar to nothing,
nothing is cut from them, and the mix, which takes words, takes none of them); rows with a null doc_id pass the first
three stages and are mixed and packed; rows that repeat are one document for the near duplicates and documents of their
own elsewhere; an empty table stays empty; extra columns are carried along, whatever their names, up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import jaccard, mixing, packing, quality, suffix_dedup
from fieldloom.llm.columns import aside
from fieldloom.llm.storage import materialize, release, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = aside(docs, "doc_id", "text")
    return back(quality.score_quality(own, model, column="_quality").filter(F.col("_quality") >= quality.THRESHOLD))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard similarity links."""
    return jaccard.keep_one_of_each(docs)


def repeated_substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that start in a smaller document too; n_chars follows the text."""
    own, back = aside(docs, "doc_id", "text")
    cut = back(suffix_dedup.remove_repeats(own))
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in token sequences."""
    pieces = materialize(packing.cut_pieces(docs))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_substring_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the classifier, the suffix arrays or the tokenizer; tests/llm/test_warc_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again, and what it wrote on its way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        before = written()
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
            release(spark, before)
    return docs
