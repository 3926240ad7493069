import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.operators import models, tasks

INNER = T.StructType([T.StructField("x", T.StringType(), False), T.StructField("y", T.BooleanType())])
KIND = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.DoubleType()), T.StructField("c", T.ArrayType(INNER))])


def test_fitted():
    assert models.fitted({"a": 1, "b": 2, "c": [{"x": "s", "z": 0}], "d": 1}, KIND) == {"a": 1, "b": 2.0, "c": [{"x": "s", "y": None}]}
    assert models.fitted({"a": 1}, KIND) == {"a": 1, "b": None, "c": None}


@pytest.mark.parametrize(
    ("value", "why"),
    [
        ([], "answer is no object"),
        ({}, "answer.a is missing"),
        ({"a": True}, "answer.a is no int"),
        ({"a": 2**31}, "answer.a is no int"),
        ({"a": 1.0}, "answer.a is no int"),
        ({"a": 1, "b": float("nan")}, "answer.b is no double"),
        ({"a": 1, "b": 10**400}, "answer.b is no double"),
        ({"a": 1, "c": "x"}, "answer.c is no list"),
        ({"a": 1, "c": [{"x": "s"}, {"y": True}]}, r"answer.c\[1\].x is missing"),
        ({"a": 1, "c": [{"x": "s", "y": 1}]}, r"answer.c\[0\].y is no boolean"),
    ],
)
def test_not_fitted(value, why):
    with pytest.raises(ValueError, match=why):
        models.fitted(value, KIND)


SCORE = T.StructType([T.StructField("score", T.IntegerType(), False)])


def ask(queue, *keys):
    return models.asked(queue, "{{items}}", "rows", "k", SCORE, [{"k": k} for k in keys], tries=2, waits=())


def rows(*said):
    return json.dumps({"rows": [{"k": k, "score": s} for k, s in said]})


def test_whole_batch_is_one_prompt():
    queue = tasks.Queue(rows(("a", 1), ("b", 2), ("ghost", 3), ("a", 4)))
    assert ask(queue, "a", "b") == [({"score": 1}, None), ({"score": 2}, None)]
    assert len(queue.prompts) == 1


def test_missing_and_bad_rows_are_asked_alone():
    queue = tasks.Queue(rows(("a", 1), ("b", "high")), rows(("b", 2)), rows(("c", 3)))
    assert ask(queue, "a", "b", "c") == [({"score": 1}, None), ({"score": 2}, None), ({"score": 3}, None)]
    assert "answer.score is no int" in queue.prompts[1] and '"a"' not in queue.prompts[1]


def test_one_key_fails_for_itself():
    queue = tasks.Queue(rows(("a", 1)), rows(), rows(("a", 9)))
    assert ask(queue, "a", "b") == [({"score": 1}, None), (None, "ValueError: b has no row")]


def test_batch_without_json_is_asked_one_by_one():
    queue = tasks.Queue("no", "no", rows(("a", 1)), "no", "no")
    got = ask(queue, "a", "b")
    assert got[0] == ({"score": 1}, None) and got[1][0] is None and "no JSON" in got[1][1]


def test_call_that_breaks_off_is_all_items_error():
    queue = tasks.Queue(tasks.Broken("cut"))
    assert ask(queue, "a", "b") == [(None, "Broken: cut")] * 2 and len(queue.prompts) == 1


def test_repeated_keys_are_asked_alone():
    queue = tasks.Queue(rows(("a", 1), ("b", 2)), rows(("a", 3)))
    assert ask(queue, "a", "b", "a") == [({"score": 1}, None), ({"score": 2}, None), ({"score": 3}, None)]


def echo(prompt):
    return json.dumps({"assessments": [{"id": x["id"], "quality_score": len(x["said"] or "")} for x in json.loads(prompt)]})


def test_frames(spark):
    df = spark.createDataFrame([(1, "xy", "t1"), (None, "x", "t2"), (2, None, "t3"), (3, "long " * 9000, "t4")], "id long, said string, tape string")
    good, failed = models.score_reviews(df, "id", ["said"], "{{items}}", echo, reviewed="tape")
    assert {r.id: (r.quality_score, r.recording_complaints, r.reviewed_identifier) for r in good.collect()} == {1: (2.0, [], "t1"), 2: (0.0, [], "t3"), 3: (45000.0, [], "t4")}
    assert [(r.id, r.error) for r in failed.collect()] == [(None, "no key")]
    none, left = models.score_reviews(df.limit(0), "id", ["said"], "{{items}}", echo)
    assert none.count() == left.count() == 0
    with pytest.raises(ValueError):
        models.run_batched(df, "quality_score", [], "", echo, "assessments", models.ASSESSMENT)


def test_complaints_of_the_reviewed_recording_alone(spark):
    said = spark.createDataFrame([("p", "b", ["x", "y"]), ("q", "c", None), ("r", None, ["x"])], "p string, reviewed_identifier string, recording_complaints array<string>")
    tapes = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("r", None), ("s", "b")], "p string, item string")
    got = models.complaints(tapes, said, "p", "item").orderBy("p", "item")
    assert [(r.p, r["item"], r.complaints) for r in got.collect()] == [("p", "a", 0), ("p", "b", 2), ("q", "c", 0), ("r", None, 0), ("s", "b", 0)]


def test_setlists_of_a_model_rank_like_parsed_ones(spark):
    def provider(prompt):
        return json.dumps({"setlists": [{"show": x["show"], "items": [{"title": "Bertha", "set": "1"}, {"title": "Deal", "set": "2", "segue": True}], "confidence": "sure"} for x in json.loads(prompt)]})

    df = spark.createDataFrame([("s", "x")], "show string, text string")
    good, failed = models.extract_setlists(df, "show", "text", "{{items}}", provider)
    row = good.withColumn("n", F.size("items")).first()
    assert [tuple(x) for x in row["items"]] == [("Bertha", "bertha", "1", False), ("Deal", "deal", "2", True)] and row.confidence == "low" and row.n == 2
    assert failed.count() == 0


def test_models_are_asked_once_a_show(spark, tmp_path):
    """Answers that a task uses more than once are written out first."""
    asked = str(tmp_path / "asked")

    def provider(prompt):
        with open(asked, "a") as f:
            f.write("x\n")
        said = json.loads(prompt)[0]
        tracks = [{"index": 1, "set": "1", "segue": False, "matched_title": ""}]
        return json.dumps({"shows": [{"show": said["show"], "asserted_songs": ["a"], "asserted_dates": [], "asserted_set_count": 1, "tracks": tracks}]})

    shows = spark.createDataFrame([(str(k), "said", 1, "a", "1977-05-08", "1") for k in range(6)], "show string, text string, k int, title string, date string, label string")
    good, failed = models.vet_research(shows, shows, shows, "show", "text", "title", "date", "{{items}}", provider)
    assert (good.count(), failed.count()) == (6, 0)
    assert len(open(asked).readlines()) == 6
    good, failed = models.align_structures(shows, shows, "show", "k", "title", "k", "title", "label", "{{items}}", provider)
    assert (good.count(), failed.count()) == (6, 0)
    assert len(open(asked).readlines()) == 12
