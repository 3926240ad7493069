import json

import pytest
from pyspark.sql import functions as F

from stagewise.operators import removals, stages

SCHEMA = "performance string, status string, pos long"


@pytest.fixture
def shelf(spark, tmp_path):
    table = stages.Kept(spark, str(tmp_path / "shows"), "show")
    shows = spark.createDataFrame([("a", "p1", "ready"), ("b", "p2", "held"), ("c", None, "ready"), ("d", "p4", None)], "show string, performance string, state string")
    table.add(stages.fingerprints("show", [shows]), shows)
    ledger = str(tmp_path / "ledger")
    spark.createDataFrame([("p1", "selected", 1), ("p1", "delivered", 2), ("p2", "selected", 3), (None, "odd", 4)], SCHEMA).write.json(ledger)
    return shows, table, ledger


def outcomes(plan, table, ledger):
    return {r["show"]: r.outcome for r in removals.apply_removals(plan, table, ledger, SCHEMA, "performance", "status", "pos").collect()}


def left(table):
    return sorted(r["show"] for r in table.rows().collect())


def history(spark, ledger):
    return sorted((r.performance or "", r.status) for r in spark.read.schema(SCHEMA).json(ledger).collect())


def test_plan(spark, shelf):
    shows, table, _ = shelf
    wish = shows.unionByName(shows).unionByName(spark.createDataFrame([("z", "p9", "ready")], shows.schema))
    plan = {r["show"]: r.refusal for r in removals.removal_plan(wish, table, "performance", "state", removals.FORGET).collect()}
    assert plan == {"a": None, "b": "held", "c": "no performance", "d": None, "z": "not in the library"}
    asked = removals.removal_plan(shows, table, "performance", "state", states=["held"])
    assert asked.where("refusal is not null").count() == 0 and left(table) == list("abcd")
    assert removals.removal_plan(shows, table, "performance", "state", "burn").where("refusal = 'unknown fate'").count() == 3
    assert removals.removal_plan(shows.limit(0), table, "performance", "state").count() == 0


def test_forget_and_again(spark, shelf):
    shows, table, ledger = shelf
    plan = removals.removal_plan(shows, table, "performance", "state", removals.FORGET)
    rows = plan.collect()  # the plan as it was confirmed
    plan = spark.createDataFrame(rows, plan.schema)
    assert outcomes(plan, table, ledger) == {"a": "removed", "b": "held", "c": "no performance", "d": "removed"}
    want = [("", "odd"), ("p2", "selected")]
    assert left(table) == ["b", "c"] and history(spark, ledger) == want
    assert outcomes(plan, table, ledger)["a"] == "gone already" and history(spark, ledger) == want


def test_suppress_is_written_once(spark, shelf):
    shows, table, ledger = shelf
    plan = spark.createDataFrame(removals.removal_plan(shows.where("show = 'a'"), table, "performance", "state", removals.SUPPRESS).collect(), "show string, performance string, fingerprint string, fate string, refusal string")
    for _ in range(2):
        outcomes(plan, table, ledger)
    assert [x for x in history(spark, ledger) if x[0] == "p1"] == [("p1", "delivered"), ("p1", "rejected"), ("p1", "selected")]


def test_what_changed_since_stays(spark, shelf):
    shows, table, ledger = shelf
    plan = removals.removal_plan(shows, table, "performance", "state")
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    new = shows.where("show = 'a'").withColumn("state", F.lit("packaged"))
    table.add(stages.fingerprints("show", [new]), new)
    assert outcomes(plan, table, ledger) == {"a": "changed since the plan", "b": "held", "c": "removed", "d": "removed"}
    assert left(table) == ["a", "b"]


def test_commit_between_is_checked_anew(spark, shelf, monkeypatch):
    shows, table, ledger = shelf
    plan = removals.removal_plan(shows.where("show in ('a', 'd')"), table, "performance", "state")
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    new = shows.where("show = 'a'").withColumn("state", F.lit("packaged"))
    plain, calls = table.add, []

    def add(done, rows, after=None):
        if not calls:  # another writer is faster
            calls.append(after)
            plain(stages.fingerprints("show", [new]), new)
        return plain(done, rows, after)

    monkeypatch.setattr(table, "add", add)
    assert outcomes(plan, table, ledger) == {"a": "changed since the plan", "d": "removed"}
    assert left(table) == ["a", "b", "c"] and json.dumps(calls) == "[1]"
