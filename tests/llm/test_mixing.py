import random
from collections import defaultdict

import pytest

from stagewise.llm.mixing import mix, mixed_documents


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by dealing the excess again until none is above."""
    left, target, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free and left > 1e-9:
        w = sum(weights[i] for i in free)
        deal = {i: left * weights[i] / w for i in free}
        left = 0.0
        for i in list(free):
            room = cap * sizes[i] - target[i]
            target[i] += min(room, deal[i])
            left += max(0.0, deal[i] - room)
            if deal[i] >= room:
                free.discard(i)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_budgets(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" * rnd.randint(0, 9) for _ in range(rnd.randint(0, 30))), rnd.choice(["a", "a", "a", "b", "c", None, "Z", "é"])) for i in range(300)]
    rows[5] = (5, None, "a")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, buckets=8).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s}) + [None]
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    target = dict(zip(names, fill([total[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.5
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mix(df.repartition(7), buckets=8).collect()}
    # at most one document of a source is cut
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        assert sum(r.taken not in (epochs * r["size"], (epochs + 1) * r["size"]) for r in got if r.source == s) <= 1
    copies = mixed_documents(df, buckets=8)
    assert copies.columns == df.columns


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", "x", 9), (1, "a b", "x", 9), (2, "", "y", 9), (3, "z " * 50_000, None, 9), (None, "q", "x", 9)], "doc_id long, text string, source string, taken int")
    got = mix(df).collect()
    assert len(got) == 5 and {r.target for r in got if r.source == "y"} == {0.0}
    assert mix(df.limit(0)).count() == 0
    only_empty = mix(df.where("doc_id = 2")).collect()
    assert [(r["size"], r.target, r.taken) for r in only_empty] == [(0, 0.0, 0)]


def test_mixed_documents_keep_columns_named_like_results(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2], 100 + i, "keep", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, taken string, target double")
    got = mixed_documents(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}
    assert mixed_documents(df.limit(0)).count() == 0


def test_joined_sources(spark, monkeypatch):
    from stagewise.llm import mixing

    df = spark.createDataFrame([(i, "w " * (i % 7), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    want = sorted(tuple(r) for r in mix(df, carry=["doc_id"], buckets=4).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(tuple(r) for r in mix(df, carry=["doc_id"], buckets=4).collect()) == want
