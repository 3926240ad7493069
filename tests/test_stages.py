import threading

import pytest
from pyspark.sql import functions as F

from stagewise.operators.stages import Flow, Kept, Stage, closure, fingerprints, rebuilt, stale, touched


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_closure_and_touched(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")], "before string, after string")
    got = {}
    for r in closure(edges).collect():
        got.setdefault(r.stage, set()).add(r.later)
    assert got == {"a": set("abcde"), "b": set("bce"), "c": set("ce"), "d": set("dce"), "e": {"e"}}
    changed = spark.createDataFrame([(1, "b"), (1, "b"), (2, "c"), (None, "e"), (3, "nowhere")], "show long, stage string")
    got = {(r.show, r.stage) for r in touched(changed, edges, "show", "stage", ["c"]).collect()}
    assert got == {(1, "b"), (1, "e"), (2, "c"), (2, "e"), (None, "e")}


def test_fingerprints_and_stale(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", None), (2, "z", 2.0), (3, "w", 0.0)], "k long, t string, v double")
    same = fingerprints("k", [a.orderBy(F.desc("t")).select("v", "k", "t")])
    assert rows_of(fingerprints("k", [a])) == rows_of(same)
    b = spark.createDataFrame([(1, "x", 1.0), (1, "y", 0.0), (2, "z", 2.0), (4, "w", 0.0)], a.schema)
    assert rows_of(stale(fingerprints("k", [b]), fingerprints("k", [a]), "k")) == [(1, "changed"), (3, "gone"), (4, "new")]
    assert len(rows_of(stale(fingerprints("k", [a], {"p": 1}), fingerprints("k", [a]), "k"))) == 3


def flow(spark, path, seen, fail=None, weight=1):
    def stage(name):
        def compute(rows):
            keys = [r.show for r in rows.select("show").distinct().collect()]
            if fail and fail[0] == name and fail[1] in keys:
                raise RuntimeError("killed")
            seen.setdefault(name, []).extend(keys)
            return rows.select("show", (F.col("v") + weight).alias("v"))

        return compute

    names = ["select", "gather", "research", "package"]
    return Flow(spark, str(path), "show", [Stage(n, [b], stage(n), {"weight": weight}) for n, b in zip(names, ["shows", *names], strict=False)])


def test_flow_resumes_and_redoes(spark, tmp_path):
    shows = spark.createDataFrame([(k, k * 10) for k in range(6)], "show long, v long")
    seen: dict = {}
    # killed in the middle of a stage: what was finished stays finished
    with pytest.raises(RuntimeError):
        flow(spark, tmp_path, seen, ("gather", 4)).run({"shows": shows}, batches=4)
    out = flow(spark, tmp_path, seen).run({"shows": shows}, batches=4)
    assert {n: sorted(k) for n, k in seen.items()} == {n: list(range(6)) for n in ("select", "gather", "research", "package")}
    assert rows_of(out["package"]) == [(k, k * 10 + 4) for k in range(6)]
    # nothing changed: nothing runs
    seen.clear()
    flow(spark, tmp_path, seen).run({"shows": shows})
    assert not seen
    # one show changed, one came, one went
    shows = spark.createDataFrame([(k, k * 10 + (k == 2)) for k in range(1, 7)], shows.schema)
    out = flow(spark, tmp_path, seen).run({"shows": shows})
    assert {n: sorted(k) for n, k in seen.items()} == {n: [2, 6] for n in ("select", "gather", "research", "package")}
    assert rows_of(out["package"]) == [(k, k * 10 + 4 + (k == 2)) for k in range(1, 7)]
    # redo: the show's later stages only; research stays
    seen.clear()
    some = shows.where("show = 3")
    assert flow(spark, tmp_path, seen).redo(some, "gather") == {"gather": 1, "package": 1}
    out = flow(spark, tmp_path, seen).run({"shows": shows})
    assert seen == {"gather": [3], "package": [3]} and out["package"].count() == 6
    with pytest.raises(ValueError, match="unknown stage"):
        flow(spark, tmp_path, seen).redo(some, "nowhere")
    # a parameter changed: everything is stale
    seen.clear()
    flow(spark, tmp_path, seen, weight=2).run({"shows": shows})
    assert sorted(seen["package"]) == list(range(1, 7))


def test_versions_stay_for_their_readers(spark, tmp_path):
    """Readers at any time see a whole version, while versions are added and compacted."""
    table = Kept(spark, str(tmp_path / "t"), "k")

    def frame(v):
        return spark.range(50).select(F.col("id").alias("k"), F.lit(v).alias("v"))

    def write(v):
        table.add(fingerprints("k", [frame(v)]), frame(v))

    write(0)
    wrong, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                rows = Kept(spark, table.path, "k").rows().collect()
                if len(rows) != 50 or len({r.v for r in rows}) != 1:
                    wrong.append(rows)
            except Exception as e:
                wrong.append(e)

    readers = [threading.Thread(target=read) for _ in range(3)]
    for r in readers:
        r.start()
    for v in range(1, 4):
        write(v)
    stop.set()
    for r in readers:
        r.join()
    assert not wrong
    pinned = table.rows(2)
    write(9)
    assert {r.v for r in pinned.collect()} == {1}
    table.compact(keep=1)
    assert {r.v for r in table.rows().collect()} == {9} and len(table.commit(table.versions()[-1])["parts"]) == 1
    # a part without a commit doesn't count
    frame(77).write.parquet(f"{table.path}/parts/lost/rows")
    assert table.rows().where("v = 77").isEmpty()


def test_rebuild_falls_back(spark, tmp_path):
    table = Kept(spark, str(tmp_path / "index"), "artist")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "artist string, n int")

    def broken():
        raise OSError("no network")

    with pytest.raises(OSError):
        rebuilt(table, broken, 10)
    assert rows_of(rebuilt(table, lambda: df, 10)) == [("a", 1), ("b", 2)]
    assert rows_of(rebuilt(table, broken, 1000)) == [("a", 1), ("b", 2)]  # young enough: not built at all
    assert rows_of(rebuilt(table, broken, 0)) == [("a", 1), ("b", 2)]
    failing = df.select("artist", F.when(F.col("n") == 2, F.raise_error(F.lit("bad page"))).otherwise(F.col("n")).cast("int").alias("n"))
    assert rows_of(rebuilt(table, lambda: failing, 0)) == [("a", 1), ("b", 2)]
    assert rows_of(rebuilt(table, lambda: df.where("n = 2").withColumn("n", F.lit(7)), 0)) == [("b", 7)]
