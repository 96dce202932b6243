import random

from . import corpus
from fieldloom.llm import graph, jaccard


def plain_sets(data):
    out = []
    for doc_id, text, *_ in data:
        w = corpus.words("".join(c.lower() if c.isascii() else c for c in text or ""))
        out.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def plain_components(sets):
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(items):
        for b, t in items[:i]:
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def near_copies(seed, n_groups=4, size=40):
    """Groups in which each text differs from the others in a few words, chains of drifting texts, and a hot passage."""
    draw = random.Random(seed)
    out, doc_id = [], 10_000
    passage = corpus.sentence(draw, 60)
    for g in range(n_groups):
        w = corpus.sentence(draw, 80).split(" ")
        for k in range(size):
            v = list(w)
            for _ in range(draw.randint(0, 3)):
                v[draw.randrange(len(v))] = f"w{draw.randrange(50)}"
            if g == 1:
                w = v
            out.append((doc_id, " ".join(v), "en", "hot", 1))
            doc_id += draw.randint(1, 5)
    for k in range(size):
        out.append((doc_id, corpus.sentence(draw, draw.choice([8, 10, 12, 30])) + " " + passage, "en", "hot", 1))
        doc_id += 1
    draw.shuffle(out)
    return out


def test_jaccard_join_matches_brute_force(spark):
    data = corpus.rows() + near_copies(5)
    got = jaccard.similar_components(corpus.frame(spark, data, n_shingles="clash", node=1, component_id=2)).collect()
    sets = plain_sets(data)
    want = plain_components(sets)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((d, len(s), want[d]) for d, s in sets if d is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len(set(want.values())) < len(want) - 50


def test_small_salt_and_shards_change_nothing(spark, monkeypatch):
    data = near_copies(9)
    monkeypatch.setattr(jaccard, "SALT", 7)
    monkeypatch.setattr(jaccard, "SHARD_SHINGLES", 64)
    monkeypatch.setattr(jaccard, "PACK_ENTRIES", 8)
    monkeypatch.setattr(jaccard, "TRIES", 1)
    monkeypatch.setattr(jaccard, "LARGE_GROUP", 5)
    got = jaccard.similar_components(corpus.frame(spark, data)).collect()
    want = plain_components(plain_sets(data))
    assert {r.doc_id: r.component_id for r in got} == want


def test_compared_pairs_of_a_large_group():
    """All fitting pairs of different components in a large and a small group, and the best of them."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(4)
    base = np.unique(draw.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.unique(np.where(draw.random(len(base)) < draw.choice([0, 0.05, 0.1, 0.4]), draw.integers(0, 1 << 63, len(base), dtype=np.uint64), base)) for _ in range(150)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    m, bits = len(sets), jaccard._bitmaps(np.concatenate(sets), at)
    component = np.where(draw.random(m) < 0.6, 0, np.arange(m)).astype(np.int64)
    rows = np.concatenate((np.arange(m), np.arange(0, m, 9)))
    table = pa.table({"shingle": np.repeat([5, 6], [m, len(rows) - m]), "node": rows * 10, "n": np.diff(at)[rows], "place": np.zeros(len(rows), np.int64), "component": component[rows]})
    order = draw.permutation(m)
    known = pa.table({"name": order * 10, "bits": pa.array([bits[k] for k in order], pa.binary())})
    for tries in (None, 1):
        got = jaccard._crossing(table, known, tries).to_pydict()
        pairs = {(a // 10, b // 10): s for a, b, s in zip(got["a"], got["b"], got["slack"])}
        assert all(component[a] != component[b] and a < b for a, b in pairs)
        links = {(i, j) for i in range(m) for j in range(i + 1, m) if component[i] != component[j] and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - k)}
        if tries is None:
            assert links <= set(pairs) and len(links) > 100
            every = pairs
        else:
            assert set(pairs) < set(every) and {x for p in every for x in p} == {x for p in pairs for x in p}


def test_keep_one_of_each(spark):
    data = corpus.rows() + near_copies(5, 2, 10)
    want = plain_components(plain_sets(data))
    kept = jaccard.keep_one_of_each(corpus.frame(spark, data, component_id="clash"))
    assert kept.columns == [*corpus.SCHEMA.names, "component_id"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    draw = __import__("random").Random(3)
    one, two, three = (corpus.sentence(draw, 30) for _ in range(3))
    rows = [(1, one, "en", "s", 1), (2, one, "en", "s", 1), (2, two, "en", "s", 1), (2, two, "de", "s", 1), (3, two + " more", "en", "s", 1), (3, three, "en", "s", 1), (3, "", "en", "s", 0), (None, one, "en", "s", 1), (None, None, "en", "s", 0)]
    got = [(r.doc_id, r.text) for r in jaccard.keep_one_of_each(corpus.frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (2, two), (3, three), (3, ""), (None, one), (None, None)], key=str)


def test_empty(spark):
    assert jaccard.similar_components(corpus.frame(spark, [])).count() == 0


def test_components_of_paths(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(300, 340), draw.randrange(300, 340)) for _ in range(30)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {k: v for k, v in got.items()} == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
