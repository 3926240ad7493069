import itertools
import math
import random

import numpy as np

from stagewise.llm.quality import document_scores, fit, held_out, line_features, marginals, score_quality, train


def test_marginals_by_brute_force():
    rnd = np.random.default_rng(1)
    sizes = [1, 4, 3, 6]
    doc = np.repeat(np.arange(4), sizes)
    evidence, pairs = rnd.normal(size=len(doc)), rnd.normal(size=(2, 2))
    good, expected = marginals(evidence, doc, pairs)
    total = np.zeros((2, 2))
    for d in range(4):
        e = evidence[doc == d]
        z, m, c = 0.0, np.zeros(len(e)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(e)):
            w = math.exp(sum(v * x for v, x in zip(y, e, strict=True)) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += w
            m += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                c[a, b] += w
        assert np.allclose(good[doc == d], m / z)
        total += c / z
    assert np.allclose(expected, total)


def test_long_documents_stay_finite():
    doc = np.zeros(20_000, np.int64)
    good, _ = marginals(np.full(20_000, 50.0), doc, np.array([[3.0, -3.0], [-3.0, 3.0]]))
    assert np.isfinite(good).all() and good.min() > 0.99


def test_features():
    x, chars, doc = line_features(["AB cd\n\nfoo foo foo", "", "é1!$"])
    assert doc.tolist() == [0, 0, 0, 1, 2] and chars.tolist() == [5, 0, 11, 0, 4]
    assert x[0, 1] == 0.5 and abs(x[2, 5] - 2 / 3) < 1e-9
    assert x[1, 8] == 1 and x[4, 2] == 0.5 and x[4, 3] == 0.25 and x[4, 4] == 0


def sample(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(n):
        bad = rnd.random() < 0.3
        lines = [" ".join((word().upper() + "!!") if bad and rnd.random() < 0.9 else word() for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 6))]
        rows.append((i, "\n".join(lines), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = sample(500, 3)
    docs = spark.createDataFrame([(i, t, "old") for i, t, _ in rows] + [(900, None, "old"), (901, "", "old")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = train(docs, labels)
    scored = score_quality(docs.withColumn("held_out", held_out("doc_id")), model)
    assert scored.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in scored.collect()}
    right = [got[i].predicted == y for i, _, y in rows if got[i].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    again = score_quality(docs, train(docs.repartition(3), labels.repartition(5)))
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert train(docs, none) == 0.5
    assert [r.predicted for r in score_quality(docs, 0.5).collect()] == [1, 1]
    assert score_quality(docs.limit(0), 0.5).count() == 0
    assert document_scores([], (np.zeros(1), np.zeros((2, 2)))).size == 0


def test_fit_separates():
    x, _, doc = line_features(["good line here", "BAD!! BAD!! LINE!!"] * 20)
    w, pairs = fit(x, doc, np.array([1, 0] * 20))
    s = document_scores(["fine words", "VERY!! BAD!!"], (w, pairs))
    assert s[0] > 0.8 and s[1] < 0.2


def test_repeated_rows_and_bounded_lines(spark):
    rows = sample(200, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in rows[:20]] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, y) for i, _, y in rows[:9]] + [(None, 1)], "doc_id long, quality int")
    scores = {}
    for r in score_quality(docs, train(docs, labels)).collect():
        assert scores.setdefault(r.doc_id, r.score) == r.score
    few = train(docs, labels, lines=60)
    assert not isinstance(few, float) and train(docs, labels, lines=0) == 0.5
