import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from . import corpus
from .test_jaccard import plain_components, plain_sets
from .test_rules_models import check_places
from .test_suffix_dedup import plain
from fieldloom.llm import mixing, registry, suffix_dedup, warc

COLUMNS = "record_id long, url string, date long, type string, etag string, last_modified string, digest string, headers map<string,string>"
URL = "http://www.Site.org:80/a/?b=2&a=1&utm_source=x#top"


def record(i, date, kind, etag=None, modified=None, url=URL, headers=None):
    return (i, url, date, kind, etag, modified, f"d{i}" if kind == "response" else None, headers if headers is not None else {"ETag": etag or "", "Content-Type": "text/html"})


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_ROWS", 2)
    rows = [
        record(1, 10, "response", "x", "m1"), record(2, 20, "response", "y", "m2", url="https://site.org/a?a=1&b=2"), record(3, 20, "response", "z", "m3"),
        record(4, 15, "revisit", "W/x", headers={"Cache-Control": "no-store", "content-length": "0", "Date": "d"}), record(5, 20, "revisit", "x"), record(6, 25, "revisit", "z"), record(7, 30, "revisit", "x"),
        record(8, 5, "revisit", "x"), record(9, 40, "revisit", None, "m3"), record(10, 41, "revisit"), record(11, 50, "revisit", "z", url=None), record(12, None, "revisit", "z"),
        record(13, 60, "revisit", "z", url="https://site.org/a?a=1&b=3", headers=None), record(14, 25, "revisit", "z"),
    ]
    frame = spark.createDataFrame(rows + [rows[5]], COLUMNS).withColumns({"key": F.lit("clash"), "status": F.lit(1)})
    got = warc.resolve_revisits(frame).collect()
    assert Counter(r.record_id for r in got) == Counter({4: 1, 5: 1, 6: 2, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1})
    by = {r.record_id: (r.response_id, r.status) for r in got}
    assert by == {4: (1, "resolved"), 5: (1, "resolved"), 6: (3, "resolved"), 7: (3, "mismatch"), 8: (None, "unresolved"), 9: (3, "resolved"), 10: (3, "unverified"), 11: (None, "unresolved"), 12: (None, "unresolved"), 13: (None, "unresolved"), 14: (3, "resolved")}
    four = next(r for r in got if r.record_id == 4)
    assert four.headers == {"etag": "x", "content-type": "text/html", "cache-control": "no-store", "date": "d"} and four.digest == "d1"
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_revisits_with_repeated_names_ids_and_stray_dates(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_ROWS", 2)
    rows = [
        record(1, 10, "response", "x", headers={"ETag": "x", "etag": "x2", "Vary": "a"}), record(1, 10, "response", "w"), record(2, 20, "revisit", "x", headers={"CACHE-CONTROL": "1", "Cache-Control": "2"}),
        record(3, 1 << 60, "revisit", "x"), record(4, 0, "response", "o"), record(5, -(1 << 60), "revisit", "x"), record(6, 9, "revisit", "o"),
    ]
    rows += [record(100 + k, 100 + k, "response" if k % 2 else "revisit", f"e{k - k % 2}") for k in range(40)]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {r.record_id: r for r in warc.resolve_revisits(frame).collect()}
    assert (got[2].response_id, got[2].status) == (1, "resolved") and got[2].headers == {"etag": "x2", "vary": "a", "cache-control": "2"}
    assert (got[3].response_id, got[5].response_id, got[6].status) == (139, None, "resolved")
    assert all(got[100 + k].response_id == (99 + k if k else 1) for k in range(0, 40, 2))


def test_stages_match_plain_versions(spark, tmp_path):
    """Each stage on its own input against a plain version of what it must do."""
    rows = [r for r in corpus.rows(3, 60) if r[0] is not None]
    rows += [(2000 + k, "BUY!! NOW!! $$$ ### " * 6, "en", "s1", 1) for k in range(0, 40)]
    frame = corpus.frame(spark, rows)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    ids = sorted({r[0] for r in rows if r[0] < 2000 and len(corpus.words(r[1])) > 8})
    spark.createDataFrame([(i, 1, 0) for i in ids] + [(2000 + k, 0, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), step in zip(corpus_pipeline.STAGES, range(5)):
        before = [tuple(r) for r in docs.collect()] if step else rows
        after = stage(spark, docs, str(tmp_path))
        if step < 4:
            assert after.columns == corpus.SCHEMA.names, name
        path = str(tmp_path / f"stage{step}")
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        got = [tuple(r) for r in docs.collect()]
        if name == "quality_classifier":
            kept = {r[0] for r in got}
            assert set(ids) <= kept and not any(r[0] >= 2000 for r in got) and Counter(got) <= Counter(before)
        elif name == "ngram_jaccard_join":
            assert sorted(r[0] for r in got) == sorted(set(plain_components(plain_sets(before)).values()))
        elif name == "suffix_array_dedup":
            want = {r[0]: r for r in plain(before)}
            assert all(len(r[1].encode()) == want[r[0]][1] - want[r[0]][2] and r[4] == len(r[1]) for r in got if r[1] is not None and r[1].isascii())
            assert len(got) == len(before)
        elif name == "source_mixing":
            texts = spark.createDataFrame([(r[0], r[3], r[1]) for r in before], "doc_id long, source string, text string")
            taken = mixing.mix_counts(texts.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("code"))).collect()
            total = Counter()
            for r in got:
                total[r[0]] += len(corpus.words(r[1]))
            assert total == Counter({r.doc_id: r.taken for r in taken if r.taken})
    check_places(docs.collect(), 2048)
    assert docs.agg(F.sum("length")).first()[0] > 0


def test_mix_keeps_worded_twins_and_null_ids(spark):
    """An empty row that shares its doc_id, or the missing one, with worded rows doesn't shift what these give."""
    rows = [(7, "", "en", "s1", 0), (7, "a b c d e", "en", "s1", 9), (8, "f g h", "en", "s2", 5), (None, None, "en", "s1", None), (None, " ", "en", "s2", 1), (None, "i j k l", "en", "s1", 7), (None, "m n", "en", "s2", 3)]
    frame = corpus.frame(spark, rows)
    counts = mixing.mix_counts(frame.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("code"))).collect()
    want = Counter({(r.doc_id, r.source, r["size"]): r.taken for r in counts if r.taken})
    got, total = mixing.mix_documents(frame).collect(), Counter()
    for r in got:
        total[next((d, s, len(corpus.words(t))) for d, t, _, s, _ in rows if d == r.doc_id and s == r.source and t and t.startswith(r.text.strip()) and r.text.strip())] += len(corpus.words(r.text))
    assert len(want) == 4 and total == want


def test_registry_and_guard(tmp_path):
    assert [sorted(k.split("_")[0] for k in registry.QUERIES)] == [sorted(f"op{n}" for n in range(1, 14))]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    root = Path(corpus_pipeline.__file__).parent
    for name in ("__spark_entry__.py", "fieldloom"):
        subprocess.run(["cp", "-r", str(root / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "fieldloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.parametrize("hot", [1, 3])
def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    data = [(k, corpus.sentence(__import__("random").Random(k % 5), 60), "en", "s", 1) for k in range(25)]
    got = suffix_dedup.remove_repeats(corpus.frame(spark, data), with_text=False).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == sorted((d, n, s) for d, _, n, _, s in plain(data))
