import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stagewise.llm.fingerprints import edit_fingerprints, fingerprint, followed, likeness


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_likeness(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        a = [str(rnd.randrange(10**6)) for _ in range(rnd.choice([3, 6, 12, 40, 300]))]
        b = a[:]
        for _ in range(rnd.randint(0, len(a) // 6)):
            b[rnd.randrange(len(b))] = "new"
        rows.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    got = df.select("i", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("s")).collect()
    errors = []
    for r in got:
        x, y = shingles(rows[r.i][1]), shingles(rows[r.i][2])
        errors.append(r.s - len(x & y) / len(x | y))
    mean = sum(errors) / len(errors)
    assert abs(mean) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06


def test_edges(spark):
    df = spark.createDataFrame([("",), (" \n",), ("one two",), ("one  two",), ("w " * 30_000,)], "t string")
    f = [r.f for r in df.select(fingerprint(F.col("t")).alias("f")).collect()]
    assert f[0] == f[1] == "" and f[2] == f[3] != "" and len(f[2]) == len(f[4]) == 256
    lit = lambda a, b: spark.range(1).select(likeness(F.lit(a), F.lit(b)).alias("s")).first().s
    assert lit("", "") == 1.0 and lit("", f[2]) == 0.0 and lit(f[2], f[2]) == 1.0
    packed = df.select(fingerprint(F.col("t"), bins=64, bits=4).alias("f")).collect()
    assert len(packed[4].f) == 64


def test_edited_texts(spark):
    rnd = random.Random(9)
    rows = [(i * 7 - 50, None if i == 4 else "é" * rnd.randint(0, 3) + " ".join(str(rnd.randrange(99)) for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in edit_fingerprints(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    assert edit_fingerprints(df.limit(0)).count() == 0
    one = edit_fingerprints(df.where("doc_id = 6")).collect()
    assert one[0].near_next == 1.0


@pytest.mark.parametrize("broadcast", [2048, 0])
def test_buckets(spark, monkeypatch, broadcast):
    from stagewise.llm import fingerprints

    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    monkeypatch.setattr(fingerprints, "BROADCAST_BUCKETS", broadcast)
    ids = [None, 3, 3, -9, *range(100, 160)]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "id long, text string")
    got = {r.text: r.next_text for r in followed(df, "id", "text").collect()}
    order = sorted(((i is None, -(i or 0), f"t{k}") for k, i in enumerate(ids)))
    names = [x[2] for x in order]
    assert got == dict(zip(names, names[1:] + names[:1], strict=True))
