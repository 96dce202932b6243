import random
import re

from . import corpus
from fieldloom.llm import paragraphs


def plain_cut(text):
    """Paragraphs as lists of lower-case words, unit by unit."""
    units = []
    for line in (text or "").split("\n"):
        w, unit = corpus.words(line), []
        for k, x in enumerate(w):
            unit.append(x)
            if x[-1] in ".!?" or k == len(w) - 1:
                units.append((unit, k == len(w) - 1))
                unit = []
    weigh = lambda unit: sum(max(1, len(x.encode()) // paragraphs.WORD_BYTES) for x in unit)
    out, pending = [], []
    for n, (unit, line_end) in enumerate(units):
        pending += unit
        is_last = n == len(units) - 1
        next_long = is_last or weigh(units[n + 1][0]) >= paragraphs.MIN_WORDS
        word = unit[-1].encode().lower()
        says = (word[0] + len(word)) % 2 == 0
        if weigh(pending) >= (paragraphs.FEW_WORDS if says else paragraphs.MIN_WORDS if weigh(unit) >= paragraphs.MIN_WORDS or next_long else paragraphs.MOST_WORDS):
            out.append(tuple(x.lower() for x in pending))
            pending = []
        elif line_end and next_long:
            pending = []
    return out


def prose(draw, n):
    return " ".join(corpus.sentence(draw, draw.randint(3, 14)).capitalize() + "." for _ in range(n))


def data(seed=1):
    draw = random.Random(seed)
    passage, stock = prose(draw, 8), corpus.sentence(draw, 9).capitalize() + "."
    out = []
    for k in range(60):
        parts = [prose(draw, draw.randint(1, 6))]
        if k % 4 == 0:
            parts.insert(draw.randint(0, 1), passage if k % 8 else re.sub(r"(\w+)\.$", "changed.", passage))
        if k % 3 == 0:
            parts.insert(0, stock)
        out.append((k * 2, draw.choice([" ", "\n"]).join(parts), "en", "s", 1))
    return out + [(500, None, None, None, None), (501, "", None, None, None), (None, passage, None, None, None), out[5], out[5]]


def test_paragraphs_are_cut_as_described(spark):
    rows = data()
    got = paragraphs.places(corpus.frame(spark, rows).select("doc_id", "text").filter("doc_id is not null")).collect()
    count = {}
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        assert tuple(corpus.words(text.encode()[r.start : r.end].decode().lower())) == plain_cut(text)[r.number]
    want = {}
    for d, t, *_ in rows:
        if d is not None and plain_cut(t):
            want[d] = want.get(d, 0) + len(plain_cut(t))
    assert count == want


def test_repeats_match_brute_force(spark):
    rows = data()
    got = paragraphs.repeated_paragraphs(corpus.frame(spark, rows, words="clash", start=1)).collect()
    shingles = lambda w: {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w}
    units = sorted({(d, n, w) for d, t, *_ in rows if d is not None for n, w in enumerate(plain_cut(t))})
    root = list(range(len(units)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, _, v) in enumerate(units):
        for j in range(i):
            a, b = shingles(v), shingles(units[j][2])
            if 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    clusters = {}
    for k in range(len(units)):
        clusters.setdefault(find(k), []).append(k)
    want, repeat = {}, set()
    for head, members in clusters.items():
        if len({units[k][0] for k in members}) > 1:
            for k in members:
                want[units[k][:2]] = units[head][:2]
                if k != head:
                    repeat.add(units[k][:2])
    words = {u[:2]: len(u[2]) for u in units}

    def run(d, n):
        total, k = 0, n
        while (d, k) in repeat:
            total, k = total + words[d, k], k + 1
        k = n - 1
        while (d, k) in repeat:
            total, k = total + words[d, k], k - 1
        return total

    assert {(r.doc_id, r.number): (r.first_doc, r.first_number) for r in got} == want
    assert {(r.doc_id, r.number) for r in got if r.removed} == {x for x in repeat if run(*x) >= paragraphs.MIN_RUN}
    assert sum(r.removed for r in got) > 10


def test_large_template_bucket_matches_all_pairs(spark, monkeypatch):
    """Many pairs of similar paragraphs that share a stock beginning: each pair is found, however full its bucket."""
    monkeypatch.setattr(paragraphs, "BLOCK", 32, raising=False)
    draw = random.Random(7)
    fresh = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(9)) for _ in range(n))
    stock, rows = fresh(24), []
    for k in range(150):
        tail = fresh(8)
        rows += [(2 * k + x, f"{stock} {tail} {end}.", "en", "s", 1) for x, end in enumerate(("one", "two"))]
    frame = corpus.frame(spark, rows).select("doc_id", "text")
    data = [paragraphs.tb.text_bytes(paragraphs.pa.array([t])) for _, t, *_ in rows]
    codes, sets, keys = [], [], []
    for part, offsets in data:
        _, _, start, end, _ = paragraphs.cut(part, offsets)
        code, h, at = paragraphs.classes_of(part, start, end)
        codes.append(int(code[0]))
        sets.append(set(h[at[0] : at[1]].tolist()))
        keys.append(set(paragraphs.band_keys(h, at)[0].tolist()))
    similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if keys[i] & keys[j] and similar(i, j)}
    assert len(want) > 140 and all(j == i + 1 for i, j in want)
    got = {r.doc_id: r.first_doc for r in paragraphs.repeated_paragraphs(frame).collect()}
    assert got == {x: i for i, j in want for x in (i, j)}


def test_bands_and_measured_recall():
    """The bands bring pairs of the threshold's similarity together as often as asked for."""
    import numpy as np

    assert 1 - (1 - 0.75**paragraphs.ROWS) ** paragraphs.BANDS >= paragraphs.RECALL
    draw = np.random.default_rng(2)
    met = []
    for _ in range(1500):
        base = draw.integers(0, 1 << 63, 28, dtype=np.uint64)
        sets = [np.sort(np.concatenate((base[:24], base[k : k + 4] if not k else draw.integers(0, 1 << 63, 4, dtype=np.uint64)))) for k in (0, 24)]
        keys = paragraphs.band_keys(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        met.append((keys[0] == keys[1]).any())
    assert np.mean(met) >= 0.97  # 24 of 32 shingles


def test_passages_in_short_lines_are_found(spark):
    """A wrapped passage, verse of short sentences that starts at any of them, and text without spaces."""
    draw = random.Random(11)
    words = [corpus.sentence(draw, 1) + str(k) for k in range(70)]
    wrapped = "\n".join(" ".join(words[k : k + 7]) for k in range(0, 70, 7))
    verse = [corpus.sentence(draw, 5) + f"{k}." for k in range(14)]
    plain = "\n".join("".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(40)) for _ in range(5))
    rows = []
    for k in range(4):
        rows += [(10 * k, prose(draw, 2) + "\n" + wrapped + "\n" + prose(draw, 2)), (10 * k + 1, prose(draw, 1) + "\n" + " ".join(verse[k % 3 :])), (10 * k + 2, plain + "\n" + prose(draw, 1))]
    gone = {}
    for r in paragraphs.repeated_paragraphs(corpus.frame(spark, [(d, t, "en", "s", 1) for d, t in rows])).filter("removed").collect():
        gone[r.doc_id] = gone.get(r.doc_id, 0) + r.end - r.start
    share = lambda d, passage: gone.get(d, 0) / len(passage.encode())
    for k in range(1, 4):
        assert share(10 * k, wrapped) > 0.7 and share(10 * k + 1, " ".join(verse[k % 3 :])) > 0.6 and share(10 * k + 2, plain) > 0.7
    assert not any(d in gone for d in (0, 1, 2))


def test_removal_and_empty(spark):
    frame = corpus.frame(spark, data(), _gone="clash")
    out = paragraphs.remove_paragraphs(frame.drop("_gone"))
    assert out.columns == corpus.SCHEMA.names and out.count() == frame.count()
    assert sum(len(r.text or "") for r in out.collect()) < sum(len(r[1] or "") for r in data())
    assert paragraphs.repeated_paragraphs(frame.limit(0)).count() == 0
