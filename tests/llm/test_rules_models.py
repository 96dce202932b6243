from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from . import corpus
from fieldloom.llm import language, line_rules, mixing, packing, quality, topk
from fieldloom.llm.batches import held_out


def plain_base(text):
    w = corpus.words(text)
    lines = [x for x in (text or "").split("\n") if corpus.words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_line_rules(spark):
    data = corpus.rows() + [(5000 + k, f"{corpus.sentence(__import__('random').Random(k), 3)} x{k}\nshared line of the host number one here indeed so", "en", "host", 9) for k in range(8)]
    data += [(5100 + k, "$$$ a#b <c> | %", "en", "s1", 9) for k in range(2)]
    got = line_rules.judge(corpus.frame(spark, data, h="x", row=1, n=2), limit=5).collect()
    assert len(got) == len(data)
    contents = defaultdict(set)
    norm = lambda x: " ".join(corpus.words(x)).lower()
    for _, text, _, source, _ in data:
        for line in (text or "").split("\n"):
            if corpus.words(line):
                contents[source, norm(line)].add(text)
    want = []
    for doc_id, text, _, source, _ in data:
        base = plain_base(text)
        gone = sum(len(corpus.words(x)) for x in (text or "").split("\n") if corpus.words(x) and len(contents[source, norm(x)]) > 5)
        want.append((doc_id, *base, not base[-1] and 2 * gone <= base[0]))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == Counter(want)
    assert any(r.n_removed_lines for r in got)
    cleaned = line_rules.remove_lines(corpus.frame(spark, data), limit=5)
    assert cleaned.columns == corpus.frame(spark, data).columns and not cleaned.filter("source = 'host' and text like '%shared line%'").count()
    assert line_rules.judge(corpus.frame(spark, [])).count() == 0


def test_quality_learns_and_handles_edges(spark):
    docs = [(k, ("BUY!! NOW!! $$$ " * 10 if k % 2 else f"calm words number {k} in a plain sentence of text "), "en", "s", 1) for k in range(200)]
    docs += [(900, None, None, None, None), (901, "", None, None, None), (None, "calm words", None, None, None)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(200)] + [(7777, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    frame = corpus.frame(spark, docs, score="clash")
    model = quality.learn(frame, labels)
    got = quality.score_quality(frame, model).select("doc_id", "score", held_out().alias("held")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.3) == (r.doc_id % 2 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert [r.held for r in got if r.doc_id is not None] == [corpus.held(r.doc_id) for r in got if r.doc_id is not None]
    again = quality.learn(frame.repartition(5), labels)
    assert (again[0] == model[0]).all() and again[1] == model[1]
    none = quality.learn(frame, labels.limit(0))
    assert quality.score_quality(frame, none).filter("abs(score - 0.5) > 1e-9").count() == 0


def test_language(spark):
    docs = [(k, ["the cat is on the mat and the dog ", "der hund und die katze sind nicht da ", "el perro y los gatos que no son de "][k % 3] * (1 + k % 9), ["en", "de", "es"][k % 3], "s", 1) for k in range(240)]
    docs += [(900, None, None, None, None), (901, "", None, None, None), (902, "12 34 --", None, None, None), (None, "der hund und die katze", None, None, None)]
    frame = corpus.frame(spark, docs, score=1, lang_pred="clash")
    got = {r.doc_id: r for r in language.identify(frame, language.learn(frame)).collect()}
    assert len(got) == len(docs)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert sum(got[k].lang_pred == got[k].lang for k in range(240)) >= 235 and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(frame, language.learn(frame.filter("lang is null"))).filter("lang_pred <> 'und'").count() == 0


def test_mixing(spark):
    frame = corpus.frame(spark, None, size="clash", target=1)
    sized = frame.withColumn("size", mixing.text_size(F.col("text")))
    got = mixing.mix_counts(sized, block_words=16).collect()
    data = corpus.rows()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(corpus.words(t))) for d, t, _, s, _ in data)
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += len(corpus.words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= max(1, 0.03 * target[s]) for s in names)
    again = mixing.mix_counts(sized.repartition(3), block_words=16).collect()
    key = lambda rs: Counter((r.doc_id, r.source, r.size, r.taken) for r in rs)
    assert key(again) == key(got)
    mixed = mixing.mix_documents(frame.drop("size"), block_words=16)
    assert mixed.columns == frame.drop("size").columns
    assert Counter({r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()}) == taken
    assert mixing.mix_counts(sized.limit(0)).count() == 0


def plain_targets(sizes):
    """Targets by pouring: all open sources rise by weight until the first is full, and so on; names in code-point order."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [s for s in names if 3 * sizes[s] - target[s] > 1e-9]
        step = min(left / sum(weight[s] for s in open_), *[(3 * sizes[s] - target[s]) / weight[s] for s in open_])
        for s in open_:
            target[s] += step * weight[s]
        left -= step * sum(weight[s] for s in open_)
    return target


@pytest.mark.parametrize("sizes", [{"a": 4, "b": 8}, {"a": 4, "b": 8, "c": 1}, {"a": 5, "b": 10, "c": 15, None: 5}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 0}, {"a": 0, "b": 7}, {"a": 1000, "b": 3, "c": 2, "d": 9000, "e": 1}])
def test_targets_of_tied_equal_and_tiny_sources(spark, sizes):
    data = [(k, s, 1) for k, s in enumerate(x for s, n in sizes.items() for x in [s] * n)] + [(-k, s, 0) for k, s in enumerate(sizes)]
    got = mixing.mix_counts(spark.createDataFrame(data, "doc_id long, source string, size long"), block_words=4).collect()
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= max(4, 0.05 * want[s]) for s in sizes)
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)


def test_the_schedule_decides_the_mix(spark, monkeypatch):
    sized = spark.createDataFrame([(k, "abc"[k % 3], 3 + k % 50) for k in range(900)], "doc_id long, source string, size long")
    order = lambda: {r.doc_id: r.first_slot for r in mixing.mix_counts(sized, block_words=20).collect()}
    by_ratio = order()
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    by_range = order()
    assert by_ratio != by_range
    slots = mixing.mix_documents(corpus.frame(spark), block_words=16, slot="at")
    assert slots.columns == [*corpus.SCHEMA.names, "at"] and slots.filter("at is null").count() == 0


def test_schedule_is_even(spark):
    sources = mixing.plan_sources(spark.createDataFrame([("a", 60000), ("b", 20000), (None, 9000)], "source string, size long"), block_words=10)
    first = mixing.schedule(sources).filter("slot < 1000").groupBy("source").count().collect()
    share = {r.source: r["count"] / 1000 for r in first}
    plan = {r.source: r.target / 89000 for r in sources.collect()}
    assert all(abs(share[s] - plan[s]) < 0.01 for s in plan)


def test_packing(spark):
    import public_tokenizers
    import numpy as np
    import zlib
    from tokenizers import Tokenizer

    data = corpus.rows() + [(3000, "mark \x01 \x01x it's <|endoftext|> É́ b", "en", "s", 1)]
    got = packing.pack(packing.cut_pieces(corpus.frame(spark, data, offset=1, length=2)), 2048).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for doc_id, text, *_ in data:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[doc_id, p // 2048, p, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert tok.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [3306, 49407, 1002]
    check_places(got, 2048)


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(spark, seed):
    import random

    draw = random.Random(seed)
    lengths = [draw.choice([30, 40, 70, 100, draw.randint(1, 100)]) for _ in range(800)]
    pieces = spark.createDataFrame([(k // 2, k % 2, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    n = check_places(packing.pack(pieces, 100).collect(), 100)
    assert n <= 1.05 * max(-(-sum(lengths) // 100), sum(x > 50 for x in lengths)) + 2
    assert packing.pack(pieces.limit(0), 100).count() == 0


def test_topk(spark):
    import random

    draw = random.Random(3)
    data = [(k, [draw.gauss(0, 0.3) for _ in range(12)]) for k in range(300)]
    data += [(k, data[5][1]) for k in range(300, 330)] + [(5, data[6][1]), (5, data[5][1]), (700, None), (800, [1.0, None]), (900, [float("nan")]), (1000, [float("inf")] * 12), (1100, []), (1200, [-0.3] * 5), (None, [1.0] * 12)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), spark.createDataFrame([r for r in data if r[0] is not None and r[0] % 100 == 0 or r[0] == 5], "vec_id long, embedding array<double>")).collect()
    import math

    clean = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, u in {(i, tuple(v)) for i, v in clean if i % 100 == 0 or i == 5}:
        best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in clean if i != q)[:10]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


@pytest.mark.parametrize("scale", [3, 1 << 20, 1 << 28])
def test_impact_index(scale):
    """Small integers with many ties, and sums beyond what doubles hold exactly."""
    import numpy as np

    draw = np.random.default_rng(scale)
    vectors, ids = draw.integers(-scale, scale + 1, (700, 9)), draw.permutation(700)
    vectors[:50] = 0
    index = topk.ImpactIndex(vectors)
    for query in [*draw.integers(-scale, scale + 1, (20, 9)), vectors[3], np.zeros(9, np.int64)]:
        rows, scores = index.search(query, ids != 7, ids, 10)
        want = sorted((-int(s), int(i)) for s, i in zip(vectors @ query, ids) if i != 7)[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids[rows])] == want
