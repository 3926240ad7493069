import json
import os
import time

import pytest
from pyspark.sql import functions as F

from stagewise.operators import recovery, sinks, tasks
from stagewise.sources import scans, setlists
from stagewise.sources.remote import CatalogSource, Refused, fetch, read_through, search, verified
from stagewise.streaming import station


def fake_pages(query, cursor):
    """Three pages of two rows."""
    k = int(cursor or 0)
    return [{"q": query, "n": 2 * k + i} for i in range(2)], str(k + 1) if k < 2 else None


def test_catalog_source(spark):
    spark.dataSource.register(CatalogSource)
    df = spark.read.format("catalog").options(transport="tests.test_sources.fake_pages", queries='["a", "b"]', pause="0").load()
    got = sorted((r.query, json.loads(r.record)["n"]) for r in df.collect())
    assert got == [(q, n) for q in "ab" for n in range(6)]


def test_fetch():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "ok"

    assert fetch(flaky, tries=3, wait=0) == "ok"

    def refused():
        calls.append(1)
        raise Refused("no")

    n = len(calls)
    with pytest.raises(Refused):
        fetch(refused, tries=3, wait=0)
    assert len(calls) == n + 1


def test_ledger_and_sinks(spark, tmp_path):
    path = str(tmp_path / "ledger")
    new = spark.createDataFrame([("p1", "delivered", "r1", 1), ("p1", "delivered", "r1", 2), ("p2", "rejected", "r1", 3)], "performance_id string, status string, run string, pos int")
    for _ in range(2):
        sinks.record(path, new, ["performance_id", "status", "run"], "pos")
    assert sorted((r.performance_id, r.pos) for r in spark.read.schema(new.schema).json(path).collect()) == [("p1", 1), ("p2", 3)]
    assert sinks.remove(path, "performance_id string, status string, run string, pos int", F.col("status") == "rejected") == 1
    assert [r.performance_id for r in scans.ledger(spark, path).collect()] == ["p1"]
    doc = sinks.rewrite_blocks('{"a": 1, "x": {"keep": true}, "dj": null}', dj={"v": 2})
    assert json.loads(doc) == {"a": 1, "x": {"keep": True}, "dj": {"v": 2}}
    sinks.write_artifact(new, str(tmp_path / "art"))
    sinks.write_artifact(new.limit(1), str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art")).count() == 1


def test_ledger_dispositions_and_lock(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "ledger")
    schema = "performance_id string, status string, run string, pos int"
    new = spark.createDataFrame([("p1", "selected", "r1", 1), ("p2", "delivered", "r1", 2)], schema)
    keys = ["performance_id", "status", "run"]
    with ThreadPoolExecutor(4) as pool:  # writers at the same time add the rows once
        list(pool.map(lambda _: sinks.record(path, new, keys, "pos"), range(4)))
    rows = lambda: sorted((r.performance_id, r.status) for r in scans.ledger(spark, path).collect())
    assert rows() == [("p1", "selected"), ("p2", "delivered")]
    sinks.suppress(path, new.where("pos = 1"), keys[:1] + ["run"], "pos")
    assert rows() == [("p1", "rejected"), ("p1", "selected"), ("p2", "delivered")]
    assert sinks.unsuppress(path, schema, "performance_id", "p1") == 1 and sinks.forget(path, schema, "performance_id", "p2") == 1
    assert rows() == [("p1", "selected")]
    with sinks.locked(spark, path), pytest.raises(TimeoutError), sinks.locked(spark, path, patience=0.1):
        pass
    (tmp_path / "ledger.lock").write_text("")
    os.utime(tmp_path / "ledger.lock", (0, 0))
    with sinks.locked(spark, path, patience=1):  # its writer died long ago
        pass


def test_rewriting_keeps_all_else(spark):
    doc = '{\n  "a": 1.50,\n  "dj" : {"v": [1, 2]} ,\n  "é": "\\u00e9"\n}\n'
    assert sinks.rewrite_blocks(doc, dj=None) == doc.replace('{"v": [1, 2]}', "null")
    assert sinks.rewrite_blocks(doc, new="x") == doc.replace('"\\u00e9"\n', '"\\u00e9",\n  "new": "x"\n')
    assert json.loads(sinks.rewrite_blocks("{}", a=1, b=2)) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        sinks.rewrite_blocks("[1]", a=1)


def fake_setlists(artist, date, asked):
    """A service that writes down what it is asked; it knows The Band by its plain name only."""
    with open(asked, "a") as f:
        f.write(f"{artist}|{date}\n")
    if artist == "down":
        raise OSError("no answer")
    if artist == "The Band!":
        return None
    known = [{"venue": {"name": "Fillmore East", "city": {"name": "New York"}}, "n": 1}, {"venue": {"name": "Other Hall", "city": {"name": "Troy"}}, "n": 2}]
    return {"setlist": known if date == "1970-02-13" else []}


def test_setlist_source(spark, tmp_path):
    asked = tmp_path / "asked"
    spark.dataSource.register(setlists.SetlistSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def read():
        return spark.read.format("setlists").options(transport="tests.test_sources.fake_setlists", pause="0", wait="0", asked=str(asked)).load()

    got = read().where(F.col("artist").isin("A", "down") & (F.col("date") == "1970-02-13") & (F.col("venue") != "Other Hall"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "artist" in plan and sorted((r.artist, r.pos, r.venue) for r in got.collect()) == [("A", 1, "Fillmore East")]
    assert sorted(set(asked.read_text().splitlines())) == ["A|1970-02-13", "down|1970-02-13"]
    errors = read().where("artist = 'down' and date = '1970-02-13' and error is not null").collect()
    assert [(r.artist, r.error) for r in errors] == [("down", "OSError: no answer")]
    with pytest.raises(Exception, match="artist"):
        read().where("date = '1970-02-13'").collect()


def test_setlists_of(spark, tmp_path):
    asked = tmp_path / "asked"
    shows = spark.createDataFrame([("s1", "A", "1970-02-13", "Fillmore", None), ("s2", "A", "1970-02-13", "?", "Troy"), ("s3", "The Band!", "1970-02-13", "fillmore east!", None), ("s4", "A", "1999-01-01", "X", None), ("s5", "down", "1970-02-13", "X", None), ("s6", None, "1970-02-13", "X", None)], "show string, artist string, date string, venue string, city string")
    for _ in range(2):
        got = setlists.setlists_of(shows, str(tmp_path / "cache"), "tests.test_sources.fake_setlists", asked=str(asked), wait=0, pause=0)
        rows = {r.show: (r.found_venue, r.error) for r in got.collect()}
        assert rows == {"s1": ("Fillmore East", None), "s2": ("Other Hall", None), "s3": ("Fillmore East", None), "s4": (None, None), "s5": (None, "OSError: no answer"), "s6": (None, None)}
    counts = {x: asked.read_text().splitlines().count(x) for x in set(asked.read_text().splitlines())}
    assert counts == {"A|1970-02-13": 1, "The Band!|1970-02-13": 1, "the band|1970-02-13": 1, "A|1999-01-01": 1, "down|1970-02-13": 6}


def fake_item(key):
    if key == "bad":
        raise Refused("no such item")
    return {"id": key}


def test_read_through(spark, tmp_path):
    cache = str(tmp_path / "cache")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), ("bad",), (None,)], "id string")
    for _ in range(2):
        got = read_through(wanted, cache, "id", "tests.test_sources.fake_item", wait=0, pause=0)
        assert sorted((r.id, r.record, r.error) for r in got.collect()) == [("a", '{"id": "a"}', None), ("b", '{"id": "b"}', None), ("bad", None, "Refused: no such item")]
    more = spark.createDataFrame([("c",)], "id string")
    assert [r.id for r in read_through(more, cache, "id", "tests.test_sources.fake_item", wait=0, pause=0).collect()] == ["c"]
    assert spark.read.parquet(cache).count() == 3
    assert [json.loads(r.record)["n"] for r in search(spark, fake_pages, "q", rows=1).collect()] == [0]
    files = spark.createDataFrame([("x", bytearray(b"abc"), "900150983CD24FB0D6963F7D28E17F72"), ("y", bytearray(b"abd"), "900150983cd24fb0d6963f7d28e17f72"), ("z", bytearray(b""), None)], "n string, content binary, md5 string")
    good, bad = verified(files, "content", "md5")
    assert sorted(r.n for r in good.collect()) == ["x", "z"] and [r.n for r in bad.collect()] == ["y"]


def test_read_through_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    cache = str(tmp_path / "cache")
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    with ThreadPoolExecutor(3) as pool:
        frames = list(pool.map(lambda _: read_through(wanted, cache, "id", "tests.test_sources.fake_item", wait=0, pause=0), range(3)))
    assert [f.count() for f in frames] == [2, 2, 2] and spark.read.parquet(cache).count() == 2


def test_playlists(spark, tmp_path):
    (tmp_path / "a.m3u").write_text("﻿#EXTM3U\n#EXTINF:12,One\n\na.mp3\nb.mp3\n#EXTINF:3,Web\nhttp://x/y.mp3\n")
    (tmp_path / "b.m3u").write_text("#EXTM3U\n")
    got = sorted((os.path.basename(r.file), r.pos, r.entry, r.title, r.problem) for r in scans.playlists(spark, str(tmp_path)).collect())
    assert got == [("a.m3u", 1, "a.mp3", "One", None), ("a.m3u", 2, "b.mp3", None, None), ("a.m3u", 3, "http://x/y.mp3", "Web", "address"), ("b.m3u", 0, None, None, "empty")]


def test_packages_and_lexicon(spark, tmp_path):
    for name, doc in {"a": '{"schema_version": 3, "dj_notes": null}', "b": '{"schema_version": 2}', "c": "{oops", "d": '{"schema_version": 3, "dj_notes": "x", "dj_audio": "y"}'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(doc)
    got = {r.path.split("/")[-2]: r.state for r in scans.packages(spark, str(tmp_path)).collect()}
    assert got == {"a": "pending", "b": "unsupported", "c": "error", "d": "ready"}
    seed = spark.createDataFrame([("a", "1"), ("b", "2"), ("", "x")], "written string, spoken string")
    assert sorted(map(tuple, scans.lexicon(seed, spark.createDataFrame([("a", "9")], seed.schema)).collect())) == [("a", "9"), ("b", "2")]


def test_probes(spark):
    raw = '{"format": {"duration": "61.5", "tags": {"title": "F", "artist": "A"}}, "streams": [{"codec_type": "audio", "codec_name": "mp3", "sample_rate": "44100", "channels": 2, "tags": {"title": "S"}}]}'
    r = scans.probes(spark.createDataFrame([(1, raw), (2, "x")], "k int, raw string"), "k", "raw").orderBy("k").collect()
    assert (r[0].codec, r[0].sample_rate, r[0].seconds, r[0].title, r[0].artist) == ("mp3", 44100, 61.5, "S", "A")
    assert r[1].codec is None


def test_pick_setlist(spark):
    rows = [("a", "Fillmore", "NY", "Fillmore East", "NY", 2), ("a", "Fillmore", "NY", "Other", "NY", 1), ("b", None, None, "X", "Y", 1), ("c", None, "LA", "X", "LA", 2), ("c", None, "LA", "Z", "SF", 1), ("d", "Q", "R", "X", "Y", 1)]
    df = spark.createDataFrame(rows, "show string, venue string, city string, rv string, rc string, pos int")
    got = {r.show: r.rv for r in scans.pick_setlist(df, "show", "venue", "city", "rv", "rc", "pos").collect()}
    assert got == {"a": "Fillmore East", "b": "X", "c": "X"}


def test_streaming_poll(spark, tmp_path):
    src, done, failed = (str(tmp_path / x) for x in ("src", "done", "failed"))
    spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "k string, n int").coalesce(1).write.json(src)
    work = lambda df: df.select("k", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("bad")).cast("int")).alias("v"))
    for _ in range(2):  # the second run finds nothing new
        station.poll(station.ledger_stream(spark, src, "k string, n int"), work, "k", done, failed, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(done).collect()) == ["a", "c"]
    assert [r.key for r in spark.read.parquet(failed).collect()] == ["b"]


def test_poll_halves(spark, tmp_path):
    src, done, failed = (str(tmp_path / x) for x in ("src", "done", "failed"))
    spark.range(200).select(F.col("id").cast("string").alias("k"), F.when(~F.col("id").isin(17, 99), 1).otherwise(0).alias("n")).coalesce(1).write.json(src)
    jobs = []

    def work(df):
        jobs.append(1)
        return df.select("k", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("bad")).cast("int")).alias("v"))

    station.poll(station.ledger_stream(spark, src, "k string, n int"), work, "k", done, failed, str(tmp_path / "cp")).awaitTermination()
    assert {r.k for r in spark.read.parquet(done).select("k").collect()} == {str(k) for k in range(200)} - {"17", "99"}
    assert spark.read.parquet(done).count() == 198 and sorted(r.key for r in spark.read.parquet(failed).collect()) == ["17", "99"]
    assert len(jobs) < 60  # one by one it was 202


def test_latest_stream(spark, tmp_path):
    from pyspark.sql.types import StructType

    rows = [("a", "2020-01-01 00:00:10", 1, "x"), ("a", "2020-01-01 00:00:10", 2, "y"), ("a", None, 9, "z"), ("b", "1969-12-31 23:59:59", None, "p"), ("b", "1969-12-31 23:59:59", -5, "q"), ("b", "1969-12-31 23:59:58", 7, "r"), (None, None, None, None), ("c", None, -3, "m"), ("c", None, -4, "n"), ("d", "2020-01-01 00:00:00", 1, "é"), ("d", "2020-01-01 00:00:00", 1, "z")]
    df = spark.createDataFrame(rows, "k string, at string, pos int, v string").withColumn("at", F.to_timestamp("at"))
    src = str(tmp_path / "src")
    df.unionByName(df).repartition(3, F.rand(1)).write.parquet(src)  # every row twice, in any order
    expected = {("a", "y"), ("b", "q"), ("c", "m"), ("d", "é"), (None, None)}
    assert set(map(tuple, station.latest_by_key(df, "k", ["at", "pos"], "v").collect())) == expected
    for idle in (None, 3_600_000):
        cp, out = (str(tmp_path / f"{x}{idle}") for x in ("cp", "out"))
        stream = spark.readStream.schema(StructType.fromJson(df.schema.jsonValue())).option("maxFilesPerTrigger", 1).parquet(src)
        put = lambda b, n, out=out: b.write.mode("overwrite").parquet(f"{out}/n={n}")
        writer = station.latest_stream(stream, "k", ["at", "pos"], "v", idle).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", cp)
        if idle is None:
            writer.trigger(availableNow=True).start().awaitTermination()
        else:
            query = writer.trigger(processingTime="1 second").start()
            end = time.monotonic() + 90
            while query.exception() is None and (query.lastProgress is None or query.lastProgress["batchId"] < 3) and time.monotonic() < end:
                time.sleep(0.5)
            query.stop()
        got = station.latest_by_key(spark.read.parquet(out), "k", ["at", "pos"], "v")
        assert set(map(tuple, got.collect())) == expected


def test_streaming_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("a", "2020-01-01 00:00:10"), ("a", "2020-01-01 00:00:10"), ("b", "2020-01-01 00:00:50"), ("c", "2020-01-01 00:01:10")]
    spark.createDataFrame(rows, "k string, at string").select("k", F.to_timestamp("at").alias("at")).coalesce(1).write.json(src)
    stream = spark.readStream.schema("k string, at timestamp").json(src)
    once = station.append_once_stream(stream, ["k", "at"], "at", "1 minute")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    q = station.counts_by_window(stream, "at", "1 minute", "1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 3]


def test_tasks(spark):
    assert tasks.extract_json('so:\n```json\n{"a": 1}\n```') == {"a": 1}
    assert tasks.extract_json('well {"a": [1]} ok') == {"a": [1]}
    with pytest.raises(ValueError):
        tasks.render("{{a}} {{b}}", a="1")
    seen = []

    def provider(prompt):
        seen.append(prompt)
        return "no" if len(seen) == 1 else '{"a": 2}'

    assert tasks.ask(provider, "p", tasks.required({"a": int})) == {"a": 2}
    assert "not valid" in seen[1]
    assert tasks.ladder({"low": "l", "medium": "m", "high": "h"}) == ["m", "m", "h"]
    assert tasks.ladder({}, model="x") == ["x"] * 3 and tasks.ladder({"high": "h"}, tier="high", attempts=2) == ["h", "h"]
    assert tasks.ladder({"low": "l"}, tier="low") == ["l"] * 3 and tasks.ladder({"low": "l", "medium": "m"}, tier="low", attempts=1) == ["l"]
    small, large = tasks.Queue(tasks.Broken("cut off"), "nothing"), tasks.Queue('```json\n{"a": 3}\n```')
    assert tasks.ask([small, large], "p", tasks.required({"a": int}), waits=(0,)) == {"a": 3}
    assert small.prompts == ["p", "p"] and "not valid" in large.prompts[0]
    with pytest.raises(tasks.Broken):
        tasks.ask(tasks.Queue(tasks.Broken("1"), tasks.Broken("2")), "p", tasks.required({}), waits=(0,))
    with pytest.raises(LookupError):
        tasks.Queue()("p")
    df = spark.createDataFrame([(1, "x"), (2, "bad")], "k int, t string")
    got = tasks.run_task(df, "k", "say {{t}}", ["t"], lambda p: "?" if "bad" in p else '{"a": 1}', {"a": int}).orderBy("k").collect()
    assert got[0].answer == '{"a": 1}' and got[1].answer is None and "ValueError" in got[1].error


def test_recovery_with_banner(spark):
    df = spark.createDataFrame([("s", "My Band<br>Big Hall<br>1977-05-08<br>A1<br>B2<br>C3<br>D4<br>F5", "My Band", "Big Hall", "1977-05-08"), ("n", None, None, None, None)], "k string, d string, a string, v string, t string")
    got = {r.k: r for r in recovery.parse_setlists(df, "k", "d", "a", ["v"], "t").collect()}
    assert [x.title for x in got["s"]["items"]] == ["A1", "B2", "C3", "D4", "F5"]
    assert got["n"]["items"] == [] and got["n"].confidence == "low"


def test_sessions_and_shelves(spark, tmp_path):
    for run, body, when in (("r1", '{"state": "picked"}', 100), ("r2", "{broken", 300), ("r3", "{}", 200)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        f = tmp_path / "runs" / run / "session.json"
        f.write_text(body)
        os.utime(f, (when, when))
    assert [(r.run, r.state) for r in scans.sessions(spark, str(tmp_path / "runs")).collect()] == [("r2", "incomplete"), ("r3", "incomplete"), ("r1", "picked")]
    for slug, name, body in (("a", "show", '{"artist": "A", "date": "1977-05-08"}'), ("a", "provenance", '{"run": "r1", "candidate": {"collection": "c", "date": "x"}}'), ("b", "provenance", '{"run": "r2", "candidate": {"collection": "c", "date": "1970-01-01"}}'), ("c", "reviews", "[]")):
        (tmp_path / "shows" / slug).mkdir(parents=True, exist_ok=True)
        (tmp_path / "shows" / slug / f"{name}.json").write_text(body)
    got = sorted((r.slug, r.artist, r.date, r.run, r.parts) for r in scans.shelves(spark, str(tmp_path / "shows")).collect())
    assert got == [("a", "A", "1977-05-08", "r1", ["provenance", "show"]), ("b", "c", "1970-01-01", "r2", ["provenance"]), ("c", None, None, None, ["reviews"])]
