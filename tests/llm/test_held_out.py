"""Models on documents that they never learn from, of the synthetic tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import language, quality

FOLDER = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no synthetic tables")


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality is not null")
    rows = quality.op4_query(spark, str(FOLDER)).filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert len(good) > 10 and len(bad) > 10
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    rows = language.op7_query(spark, str(FOLDER)).filter("held_out and lang_pred <> 'und'").join(docs, "doc_id").agg(F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("met")).first()
    assert rows.n > 100 and rows.met > 0.95
