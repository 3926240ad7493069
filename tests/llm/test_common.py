import random

import pytest

from stagewise.llm import common


@pytest.mark.parametrize("chunk", [500_000, 7])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(common, "CHUNK_EDGES", chunk)
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    rnd.shuffle(edges)
    u = common.Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.v: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {v: u.find(v) for e in edges if e[0] != e[1] for v in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunks", [2, 10])
def test_components_of_a_chain_in_random_order(spark, monkeypatch, chunks):
    monkeypatch.setattr(common, "CHUNK_EDGES", -(-2000 // chunks))
    rnd = random.Random(3)
    ids = rnd.sample(range(10**9), 2001)
    edges = list(zip(ids, ids[1:]))
    rnd.shuffle(edges)
    got = {r.v: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(chunks)).collect()}
    assert set(got) == set(ids)
    assert sum(label != min(ids) for label in got.values()) == 0


def test_bitmap(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 1000, 7)
    bitmap = common.bitmap_of(keys, F.xxhash64("id"))
    got = common.marked(spark.range(1000), F.xxhash64("id"), bitmap, "held").where("held").collect()
    held = {r.id for r in got}
    assert held >= set(range(0, 1000, 7)) and len(held) < 150
    assert not common.marked(spark.range(10), F.xxhash64("id"), bitmap.limit(0), "held").where("held").count()
    assert common.parts_for(10) == common.PARTS and common.parts_for(10**12) == common.MOST_PARTS
