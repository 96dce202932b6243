"""A small corpus with the cases that operators must handle, and plain versions of shared definitions."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def sentence(draw, n):
    return " ".join("".join(draw.choice(["ba", "ko", "tri", "é", "lum", "sen", "X"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def rows(seed=1, n=120):
    """Documents with copies, near copies, shared passages, repeated lines, runs, nulls, blanks and a hot source."""
    draw = random.Random(seed)
    passage = sentence(draw, 60)
    base = [sentence(draw, draw.randint(8, 120)) for _ in range(n // 3)]
    out = []
    for k in range(n):
        text = draw.choice(base) if k % 3 else "\n".join(sentence(draw, draw.randint(1, 30)) for _ in range(draw.randint(1, 5)))
        if k % 7 == 1:
            w = text.split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        if k % 11 == 2:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        if k % 13 == 3:
            text = "\n".join([text.split("\n")[0]] * 3) + "\tz" * 30
        if k % 17 == 4:
            text = "a" * 130 + text + "!" * 75
        out.append((k * 3 % 997, text, draw.choice(["en", "de", None]), "hot" if k % 3 else draw.choice(["s1", "s2", None, ""]), len(text)))
    out += [(1001, None, None, None, None), (1002, "", "en", "s1", 0), (1003, " \n\t ", "en", "s2", 4), (1004, "A", "en", "hot", 1), (1005, "one two three four", "de", "hot", 18), (1006, "ONE two THREE four", "de", "hot", 18)]
    out += [out[4], out[4], (1007, sentence(draw, 4000), "en", "hot", 1), (None, out[5][1], None, "s1", 3)]
    return out


def frame(spark, data=None, **more):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    from pyspark.sql import functions as F

    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df
