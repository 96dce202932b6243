import hashlib
from collections import defaultdict

import numpy as np

from fieldloom.llm import chat

ODD = ["", None, "plain", "\\", "\\\\", "<turn>", "</turn>", "\\<turn>\\", "<</turn>>", "a\nb", "\n", "é</turn>ü\\", "<tur", "n>", r"\### Assistant: </turn> ok", "日本\\<turn>語", "</turn>\n<turn>assistant\nx"]


def plain(rows):
    """Digests from the rows themselves."""
    groups, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, (role is not None, (role or "").encode()), (text is not None, (text or "").encode())))
    escape = lambda x: x.replace("\\", "\\\\").replace("<turn>", "\\<turn>").replace("</turn>", "\\</turn>")
    for conv, turns in groups.items():
        said = [(r[1].decode(), t[1].decode()) for _, _, r, t in sorted(turns)]
        learnt = "".join(t for r, t in said if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        whole = "".join(f"<turn>{escape(r).replace(chr(10), chr(92) + chr(10))}\n{escape(t)}</turn>\n" for r, t in said)
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learnt), sha(learnt), len(whole), whole)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, n_turns int")


def check(spark, rows):
    formatted = chat.format_conversations(frame(spark, rows))
    want = plain(rows)
    got = chat.read_back(formatted).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {k: v[:5] for k, v in want.items()}
    pieces = sorted(formatted.collect(), key=lambda r: r.piece)
    texts, learnt = defaultdict(str), defaultdict(str)
    for r in pieces:
        texts[r.conv_id] += r.text
        learnt[r.conv_id] += "".join(r.text[s.start : s.start + s.length] for s in r.loss)
    assert dict(texts) == {k: v[5] for k, v in want.items()}
    return pieces, learnt


def test_reads_back_what_it_formats(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "a\n<turn>"][(c + t) % 5], ODD[(3 * c + t) % len(ODD)]) for c in range(40) for t in range(c % 9)]
    rows += [(100, 1, "assistant", "b"), (100, 1, "assistant", "a"), (100, None, "user", "first"), (100, 1, "assistant", "a"), (None, 0, "assistant", "no id"), (None, 1, "user", None)]
    rows += [(-7, 0, "user", ODD[14]), (-7, 1, "assistant", ODD[14])]
    check(spark, rows)


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 300)
    monkeypatch.setattr(chat, "PIECE", 1000)
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} <turn> é " * 3) for c, n in ((1, 200), (2, 3), (3, 90), (4, 1), (5, 60)) for t in range(n)]
    rows += [(6, 0, "assistant", "long \\" * 5000), (6, 1, "user", "x")]
    pieces, _ = check(spark, rows)
    assert sum(r.conv_id == 1 for r in pieces) > 3 and sum(r.conv_id == 2 for r in pieces) == 1


def test_loss_mask_covers_what_assistants_say(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "é<turn>\\"), (1, 2, "assistant", ""), (1, 3, "Assistant", "no"), (1, 4, "assistant", "end")]
    _, learnt = check(spark, rows)
    assert learnt[1] == "é\\<turn>\\\\end"


def test_no_conversations(spark):
    assert chat.read_back(chat.format_conversations(frame(spark, []))).collect() == []


def test_control_strings_do_not_cross_rows():
    data = np.frombuffer(b"<turn><tur", np.uint8)
    assert chat.marks(data, np.array([0, 6, 10]), b"<turn>").tolist() == [0]
    assert chat.marks(data, np.array([0, 3, 10]), b"<turn>").tolist() == []
