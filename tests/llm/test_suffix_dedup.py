import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from . import corpus
from fieldloom.llm import suffix_dedup, suffixes


def plain(data, span=50):
    first = {}
    last = (1 << 63) - 1
    raw = [(last if d is None else d, (t or "").encode()) for d, t, *_ in data]
    for d, b in raw:
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            first[s] = min(first.get(s, last), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if d == last else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=str)


def repeats(seed):
    draw = random.Random(seed)
    passages = [corpus.sentence(draw, 40) for _ in range(4)] + ["a" * 200, "ab" * 80, "=" * 49, "xyz" * 30]
    out = []
    for k in range(80):
        parts = []
        for _ in range(draw.randint(0, 6)):
            p = draw.choice(passages)
            cut = draw.randint(0, len(p))
            parts.append(draw.choice([corpus.sentence(draw, draw.randint(1, 20)), p, p[cut:], p[:cut], p[cut : cut + draw.choice([49, 50, 51])]]))
        out.append((draw.randint(0, 10**6), draw.choice(["", " ", "\n"]).join(parts), "en", "hot", 1))
    return out


@pytest.mark.parametrize("seed, hot", [(1, 2000), (2, 1), (3, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    data = (corpus.rows() if seed == 1 else []) + repeats(seed)
    got = suffix_dedup.remove_repeats(corpus.frame(spark, data, n_removed="clash", block=1, _x=2), with_text=False)
    assert "text" not in got.columns
    assert key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == key(plain(data))


@pytest.mark.parametrize("wide", [1, 1024])
def test_suffix_arrays(monkeypatch, wide):
    """Both forms of the induction, on strings with few symbols, with many, and with runs."""
    monkeypatch.setattr(suffixes, "WIDE", wide)
    draw = np.random.default_rng(wide)
    for trial in range(120):
        t = draw.integers(0, int(draw.integers(1, 40)), int(draw.integers(0, 150)))
        if trial % 3 == 0:
            t = np.repeat(t, draw.integers(1, 100, len(t)))
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())  # noqa: B023
        assert suffixes.suffix_array(t).tolist() == want


def test_long_runs_of_one_symbol_take_their_length():
    import time

    draw = np.random.default_rng(1)
    t = np.concatenate((draw.integers(0, 27, 20_000), np.full(3_000_000, 5), draw.integers(0, 27, 20_000), np.full(1_000_000, 5)))
    began = time.time()
    order = suffixes.suffix_array(t)
    assert time.time() - began < 60  # one step of a bucket for each symbol would take hours
    assert (np.sort(order) == np.arange(len(t))).all()
    some = draw.choice(len(t) - 1, 2000)
    for i, j in zip(order[some], order[some + 1]):
        n = min(200, len(t) - max(i, j))
        assert t[i : i + n].tolist() <= t[j : j + n].tolist()


def test_long_run_in_a_text(spark):
    data = [(3, "=" * 60_000 + " one", "en", "s", 1), (5, "two " + "=" * 70_000, "en", "s", 1), (6, "x" * 49 + "=" * 49, "en", "s", 1)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(corpus.frame(spark, data), with_text=False).collect()}
    assert got == {3: (60_004, 0, 0), 5: (70_004, 70_000, 1), 6: (98, 0, 0)}


def test_texts_and_columns_stay(spark):
    data = repeats(4) + [(None, None, None, None, None)]
    frame = corpus.frame(spark, data, extra="e")
    got = suffix_dedup.remove_repeats(frame)
    assert got.columns == [*frame.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = got.collect()
    assert len(rows) == len(data)
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256 for r in rows if (r.text or "").isascii())
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    draw = random.Random(seed)
    s = [draw.randint(0, draw.choice([1, 2, 5, 200, 5000])) for _ in range(draw.randint(0, 150))]
    assert suffixes.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def shard(docs):
    """All runs of blocks of documents, as one shard gets them."""
    import pyarrow as pa

    blocks = [pa.table({"doc_id": [d for d, _ in b], "text": [t for _, t in b], "_content": [hashlib.md5(t.encode()).digest() for _, t in b], "_block": pa.array([n] * len(b), pa.int32())}) for n, b in enumerate(docs)]
    right = pa.schema([("doc_id", pa.int64()), ("_content", pa.binary()), ("shared", pa.binary()), ("hot", pa.binary())])
    asks = pa.concat_tables([suffix_dedup.ask(b, right.empty_table(), 1) for b in blocks])
    replies = {r["block"]: r for r in suffix_dedup.reply(asks, 2000).to_pylist()}
    beside = lambda n: pa.Table.from_pylist([{"shared": replies[n]["shared"], "hot": replies[n]["hot"]}] if n in replies else [], right)
    return pa.concat_tables([suffix_dedup.send_runs(b, beside(n), 1) for n, b in enumerate(blocks)])


def ranges(table):
    out = set()
    for r in table.to_pylist():
        out |= {(r["block"], *x) for x in zip(*(np.frombuffer(r[c], "<i4").tolist() for c in ("rows", "starts", "ends")))}
    return out


def test_a_shard_is_sorted_in_parts(monkeypatch):
    """An executor was stopped over its memory; a shard was sorted whole, and the sorting takes most of it."""
    draw = random.Random(5)
    passages = ["".join(draw.choices("abcdefgh ", k=1000)) for _ in range(60)]
    runs = shard([[(1000 * b + k, p + str(b) + passages[-k]) for k, p in enumerate(passages)] for b in range(2)])
    lengths = []
    sort = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t: lengths.append(len(t)) or sort(t))
    whole = ranges(suffix_dedup.resolve(runs))
    assert len(lengths) == 1 and len(whole) > 100
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 15, raising=False)
    assert ranges(suffix_dedup.resolve(runs)) == whole
    assert sum(lengths[1:]) == lengths[0] and max(lengths[1:]) < 1.2 * (1 << 15)


def test_parts_of_one_anchor_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", 2)
    data = repeats(6)[:40]
    got = suffix_dedup.remove_repeats(corpus.frame(spark, data), with_text=False)
    assert key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == key(plain(data))


def test_a_shard_looks_up_all_blocks_hashes_at_once():
    """The CPU time was over its budget; for each block, a shard went through the hashes of all blocks."""
    import time

    import pyarrow as pa

    draw = np.random.default_rng(7)
    pool = np.unique(draw.integers(0, 1 << 48, 1 << 18).astype(np.uint64))
    blocks = [np.unique(draw.choice(pool, 200)) for _ in range(2000)]
    table = pa.table({"block": pa.array(range(2000), pa.int32()), "single": [suffix_dedup._pack48(x[:150]) for x in blocks], "several": [suffix_dedup._pack48(x[150:]) for x in blocks]})
    began = time.process_time()
    got = {r["block"]: r for r in suffix_dedup.reply(table, 8).to_pylist()}
    assert time.process_time() - began < 5  # 0.07 here; 63 with a pass for each block
    count = Counter(np.concatenate(blocks).tolist())
    several = set(np.concatenate([x[150:] for x in blocks]).tolist())
    for k, x in enumerate(blocks):
        own = [h for h in x[:150].tolist() if count[h] > 1 or h in several]
        warm = [h for h in x.tolist() if count[h] > 8]
        assert suffix_dedup._unpack48(got[k]["shared"]).tolist() == own
        assert suffix_dedup._unpack48(got[k]["hot"]).tolist() == warm


def test_a_string_is_induced_once(monkeypatch):
    """The CPU time was over its budget; each string was induced twice, the first time for its substrings' names only."""
    draw = random.Random(8)
    t = np.frombuffer(" ".join(corpus.sentence(draw, 12) for _ in range(60)).encode(), np.uint8).astype(np.int64)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    lengths = []
    for name in ("_induce", "_induce_singly"):
        monkeypatch.setattr(suffixes, name, lambda t, *rest, work=getattr(suffixes, name): lengths.append(len(t)) or work(t, *rest))
    assert suffixes.suffix_array(t).tolist() == want
    assert len(lengths) == len(set(lengths)) > 1


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_long_substrings_are_named_by_induction(monkeypatch, rounds):
    monkeypatch.setattr(suffixes, "ROUNDS", rounds, raising=False)
    draw = np.random.default_rng(rounds)
    for trial in range(60):
        t = np.tile(np.repeat(draw.integers(0, [3, 200, 5000][trial % 3], 12), draw.integers(1, 40, 12)), 3)
        assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())  # noqa: B023
