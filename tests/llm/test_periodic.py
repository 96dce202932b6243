import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import corpus
from fieldloom.llm import periodic


def plain_runs(words, shortest=6, exponent=4):
    """(start, length, period) by trying every period."""
    n, seen = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, exponent * q):
                seen.setdefault((i, length), q)  # the smallest period first
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in seen.items())


def rewritten(doc_id, words):
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain(doc_id, text):
    words = rewritten(doc_id, corpus.words(text))
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def every_run(word):
    """All runs of a word from their definition."""
    n, out = len(word), set()
    for q in range(1, n // 2 + 1):
        for i in range(n - 2 * q + 1):
            j = i + q
            while j < n and word[j] == word[j - q]:
                j += 1
            if j - i >= 2 * q and not (i and word[i - 1] == word[i + q - 1]) and not any(q % r == 0 and r < q and all(word[k] == word[k - r] for k in range(i + r, j)) for r in range(1, q)):
                out.add((i, j - i, q))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_theorem_finds_all_runs(seed):
    rng = random.Random(seed)
    stretches = [[rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    a, b = [1], [1, 2]
    while len(b) < 60:
        a, b = b, b + a
    stretches += [b, b[::-1], [1] * 50, [3, 2, 1] * 9, [1, 2, 3] * 9 + [1], stretches[0], stretches[0]]
    text, want = [], set()
    for s in stretches:
        want |= {(len(text) + i, n, q) for i, n, q in every_run(s)}
        text += s + [0]
    assert set(zip(*(x.tolist() for x in periodic.find_runs(np.array(text))))) == want


def test_cutting_rare_words_changes_nothing():
    rng = random.Random(8)
    for _ in range(40):
        words, owner = [], []
        for d in range(rng.randint(1, 5)):
            own = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
            at = rng.randint(0, len(own))
            own[at:at] = [rng.randint(1, 30) for _ in range(rng.randint(1, 4))] * rng.randint(3, 6)
            words, owner = words + own, owner + [d] * len(own)
        a, b = (periodic.runs_of(np.array(words, np.uint64), np.array(owner), thin) for thin in (True, False))
        assert sorted(map(tuple, a.tolist())) == sorted(map(tuple, b.tolist()))


def test_documents_equal_brute_force(spark):
    rng = random.Random(3)
    rows = corpus.rows()
    for k in range(120):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        text = " ".join([corpus.sentence(rng, rng.randint(0, 30)), *base * rng.randint(2, 9), *base[: rng.randint(0, len(base))], corpus.sentence(rng, 5), "x " * rng.randint(0, 9)])
        rows.append((3000 + k, text, "en", "s", 1))
    rows += [(4000, "a " * 3000 + "b " * 3000, "en", "s", 1), (4001, " ".join(f"w{k % 700}" for k in range(4000)), "en", "s", 1), (None, "z z z z z z z", "en", "s", 1), (4002, "\t\n ", "en", "s", 1), (4000, "a a a a a a", "en", "s", 1)]
    docs = corpus.frame(spark, rows, runs="clash", code=3).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    got = periodic.strongest(periodic.periodic_runs(docs, "h")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain(r[0], r[1]) for r in rows), key=key)
    assert sum(r.n_runs > 0 for r in got) > 50
    assert periodic.strongest(periodic.periodic_runs(corpus.frame(spark, []))).collect() == []


def test_slices_do_not_matter(spark, monkeypatch):
    docs = corpus.frame(spark, corpus.rows())
    whole = sorted(map(str, periodic.periodic_runs(docs).collect()))
    monkeypatch.setattr(periodic, "SLICE", 100)
    assert sorted(map(str, periodic.periodic_runs(docs).collect())) == whole
