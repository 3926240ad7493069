import math
import random

from pyspark.sql import functions as F

from stagewise.operators import ranking


def pick(items, key, n, cap):
    """items: best first."""
    most = n if cap >= 1 else max(1, math.ceil(n * cap))
    first, rest, counts = [], [], {}
    for i in items:
        counts[key(i)] = counts.get(key(i), 0) + 1
        (first if counts[key(i)] <= most else rest).append(i)
    return (first + rest)[:n]


def test_capped_pick(spark):
    rnd = random.Random(1)
    for _ in range(4):
        rows = [(i, rnd.choice("abc"), rnd.choice(["1", "2"])) for i in range(rnd.randint(1, 25))]
        n, cap = rnd.randint(1, 12), rnd.choice([0.1, 0.34, 1.0])
        df = spark.createDataFrame(rows, "i long, a string, y string")
        got = [r.i for r in ranking.capped_pick(df, "a", [F.col("i")], n, cap).orderBy("pick").collect()]
        assert got == [r[0] for r in pick(rows, lambda r: r[1], n, cap)]


def test_capped_pick_two_axes(spark):
    rnd = random.Random(2)
    for trial in range(6):
        rows = [(i, rnd.choice("abc" if trial else "a"), rnd.choice("123")) for i in range(rnd.randint(1, 25))]
        n, cap, year_cap = rnd.randint(1, 12), rnd.choice([0.2, 0.5, 1.0]), rnd.choice([0.3, 0.5, 1.0])
        artists = {r[1] for r in rows}
        if len(artists) < 2:
            want = pick(rows, lambda r: r[2], n, year_cap)
        else:
            queues = {a: pick(q := [r for r in rows if r[1] == a], lambda r: r[2], len(q), year_cap) for a in artists}
            most = n if cap >= 1 else max(1, math.ceil(n * cap))
            want, used = [], dict.fromkeys(artists, 0)
            for r in rows:
                if used[r[1]] < most:
                    want.append(queues[r[1]][used[r[1]]])
                    used[r[1]] += 1
            want = (want + [r for r in rows if r not in want])[:n]
        df = spark.createDataFrame(rows, "i long, a string, y string")
        got = ranking.capped_pick_two_axes(df, "a", "y", ["i"], n, cap, year_cap).orderBy("pick").collect()
        assert [r.i for r in got] == [r[0] for r in want]


def test_choose_entries(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", False), (3, "b", None), (4, "a", None)], "rank int, artist string, approved boolean")
    ids = lambda d: [r["rank"] for r in d.collect()]
    assert ids(ranking.choose_entries(df, "approved", "rank", "artist", 2, False, 0.5)) == [1, 3]
    assert ids(ranking.choose_entries(df, "approved", "rank", "artist", 2, True, 0.5)) == []
    yes = df.withColumn("approved", F.when(F.col("rank") >= 3, True))
    assert ids(ranking.choose_entries(yes, "approved", "rank", "artist", 5, True, 0.1)) == [3, 4]
