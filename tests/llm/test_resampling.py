import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stagewise.llm.resampling import features, resampled

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_features(text, most, buckets):
    words = WORD.findall((text or "").translate(AZ))
    runs = [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(x.encode()) % buckets for x in runs]


def plain_resampled(docs, target, percent, least, most, buckets):
    of = [plain_features(t, most, buckets) for _, t in docs]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in target for b in plain_features(x, most, buckets)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for (i, _), (words, f) in zip(docs, of, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(words), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


ODD = ["", None, "   ", "One two ONE", "ÀB çd-x_y 12", "x" * 700 + " " + "Y" * 300, "w " * 5000, "日本 語 a\x00b"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_features_are_checksums_of_runs(most):
    bucket, n, words = features(pa.array(ODD), most, 10_000)
    for text, got, k in zip(ODD, np.split(bucket, np.cumsum(n)[:-1]), words, strict=True):
        w, want = plain_features(text, most, 10_000)
        assert k == len(w) and sorted(got.tolist()) == sorted(want)


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (2, 50_000)])
def test_by_brute_force(spark, most, buckets):
    """Groups of copies, one of a third of the rows; ties, null ids, repeated rows; columns named like results."""
    rows = [(k, f"w{k % 7} common text of words {k % 11} " * (k % 9)) for k in range(120)] + [(k, "the very same text again and again " * 3) for k in range(200, 270)]
    rows += [(3, rows[3][1]), (None, "a b c " * 10), (None, "a b c " * 10)] + [(900 + k, t) for k, t in enumerate(ODD)]
    target = ["common words 3 again", None, "", "ÀB w5 w6"]
    df = spark.createDataFrame([(i, t, 1.5, "r", 7) for i, t in rows], "doc_id long, text string, score double, rank string, kept int").repartition(6)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampled(df, t, percent=30, least_words=5, most=most, buckets=buckets, carry=["kept", "score", "rank"])
    assert got.columns == ["doc_id", "kept", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain_resampled(rows, target, 30, 5, most, buckets)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampled(df.limit(0), df).collect() == []
    assert [tuple(r) for r in resampled(df, df.limit(0), least_words=1, percent=100).select("doc_id", "n_words", "rank").collect()] == [(1, 2, 1)]
