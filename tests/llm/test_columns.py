"""Every operator that returns its input's columns gives them back unchanged, whatever their names."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from . import corpus
from fieldloom.llm import jaccard, line_rules, mixing, paragraphs, suffix_dedup
from fieldloom.llm.columns import aside

ROOT = Path(corpus_pipeline.__file__).parent / "fieldloom" / "llm"
#: All inner names that the operators write down, and some of the columns that they return.
NAMES = sorted({n for p in ROOT.glob("*.py") for n in re.findall(r"[\"'](_[a-z][a-z0-9_]*)[\"']", p.read_text())} | {"code", "node", "class", "size", "target", "slot", "pass", "carried_0", "_c0", "_c1", "_quality", "_d", "_c", "_again", "_block", "_content", "_row", "_drop", "_gone", "n_bytes"})


@pytest.fixture(scope="module")
def docs(spark):
    data = corpus.rows()[:60] + [(1007, corpus.sentence(__import__("random").Random(5), 30), "en", "hot", 1)]
    return corpus.frame(spark, data).select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES])


def unchanged(docs, out, *replaced):
    assert [c for c in out.columns if c not in replaced] == [c for c in docs.columns if c not in replaced]
    wrong = F.lit(False)
    for n in NAMES:
        if n not in replaced:
            wrong |= ~F.col(f"`{n}`").eqNullSafe(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    rows = out.select("doc_id", wrong.alias("wrong")).collect()
    assert rows and not any(r.wrong for r in rows)
    return rows


def test_operators_keep_columns(docs):
    assert len(NAMES) > 40
    n = docs.count()
    assert len(unchanged(docs, suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")) == n
    assert len(unchanged(docs, paragraphs.remove_paragraphs(docs))) == n
    assert len(unchanged(docs, line_rules.remove_lines(docs, 3))) == n
    unchanged(docs, jaccard.keep_one_of_each(docs))
    unchanged(docs, mixing.mix_documents(docs))


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(k * 3 % 997, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        unchanged(docs, stage(spark, docs, str(tmp_path)))


def test_aside(spark):
    docs = spark.createDataFrame([(1, "t", "a", "b")], "doc_id long, text string, carried_0 string, `odd.name` string")
    own, back = aside(docs, "doc_id", "text")
    assert own.columns == ["doc_id", "text", "carried_2", "carried_3"]
    assert [tuple(r) for r in back(own.withColumn("carried_0", F.lit("x"))).collect()] == [(1, "t", "a", "b")]
    assert back(own.withColumn("odd", F.lit(1)), "odd").columns == [*docs.columns, "odd"]


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark):
    draw = __import__("random").Random(11)
    shared, own = corpus.sentence(draw, 80), corpus.sentence(draw, 90)
    other = corpus.sentence(draw, 40)
    rows = [(1, shared, "en", "s", 1), (2, f"{other}\n\n{shared}", "en", "s", 1), (2, own, "en", "s", 1)]
    got = sorted(r.text for r in paragraphs.remove_paragraphs(corpus.frame(spark, rows)).collect())
    assert own in got and shared in got
    assert not any(shared in t for t in got if t != shared)
