import json
import os

import pytest

from stagewise.sources.remote import CatalogSource

#: A feed's folder, where the executors find it, too.
FOLDER = "/tmp/stagewise-feed-test"


def feed(query):
    path = os.path.join(FOLDER, query)
    return open(path).read().split() if os.path.exists(path) else []


def head(query):
    return str(len(feed(query))) if feed(query) else None


def page(query, cursor, end):
    """Two rows a page; a file named broken makes the second page fail."""
    with open(os.path.join(FOLDER, f"asked-{query}"), "a") as f:
        f.write(f"{cursor}\n")
    at = int(cursor or 0)
    if at >= 2 and os.path.exists(os.path.join(FOLDER, "broken")):
        raise OSError("cut off")
    to = min(at + 2, int(end), len(feed(query)))
    return [{"n": int(x)} for x in feed(query)[at:to]], str(to) if to > at else None


@pytest.fixture
def stream(spark, tmp_path, monkeypatch):
    spark.dataSource.register(CatalogSource)
    folder = str(tmp_path / "feed")
    os.makedirs(folder)
    if os.path.islink(FOLDER):
        os.unlink(FOLDER)
    os.symlink(folder, FOLDER)

    def run(*queries):
        rows = spark.readStream.format("catalog").options(transport="tests.test_feeds.page", head="tests.test_feeds.head", queries=json.dumps(queries), pause="0", wait="0", tries="1").load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.query, json.loads(r.record)["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def write(query, *rows):
        with open(os.path.join(folder, query), "a") as f:
            f.write("".join(f"{x}\n" for x in rows))

    run.write, run.folder = write, folder
    yield run
    os.unlink(FOLDER)


def test_restart_neither_loses_nor_repeats(stream):
    stream.write("a", 1, 2, 3)
    assert stream("a", "b") == [("a", 1), ("a", 2), ("a", 3)]
    asked = lambda q: open(os.path.join(stream.folder, f"asked-{q}")).read().split()
    assert asked("a") == ["None", "2"]
    assert stream("a", "b") == [("a", 1), ("a", 2), ("a", 3)] and asked("a") == ["None", "2"]  # nothing new, nothing asked
    stream.write("a", 4, 5, 6)
    stream.write("b", 7)
    assert stream("a", "b") == [("a", k) for k in range(1, 7)] + [("b", 7)]
    assert asked("a") == ["None", "2", "3", "5"] and asked("b") == ["None"]


def test_failed_batch_is_read_again_as_it_was(stream):
    stream.write("a", 1, 2, 3, 4)
    open(os.path.join(stream.folder, "broken"), "w").close()
    with pytest.raises(Exception, match="cut off"):
        stream("a")
    os.unlink(os.path.join(stream.folder, "broken"))
    stream.write("a", 5)  # came since: the failed batch ends where it ended
    assert stream("a") == [("a", k) for k in range(1, 5)]
    assert stream("a") == [("a", k) for k in range(1, 6)]


def test_feed_that_lost_rows_is_an_error(stream):
    stream.write("a", 1, 2, 3)
    stream("a")
    stream.write("a", 4, 5)
    open(os.path.join(stream.folder, "broken"), "w").close()
    with pytest.raises(Exception, match="cut off"):
        stream("a")
    os.unlink(os.path.join(stream.folder, "broken"))
    open(os.path.join(stream.folder, "a"), "w").close()
    with pytest.raises(Exception, match="lost rows"):
        stream("a")
