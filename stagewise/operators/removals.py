"""Removal of many shows: a plan that can be looked at, and its application, in which each show succeeds or fails for itself."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.operators import sinks
from stagewise.operators.library import split_held
from stagewise.operators.stages import Kept, Moved
from stagewise.shipping import checkpointed

#: What becomes of a removed show's history.
UNTOUCHED, FORGET, SUPPRESS = "untouched", "forget", "suppress"


def removal_plan(shows: DataFrame, table: Kept, performance: str, state: str, fate: str | Column = UNTOUCHED, states: Collection[str] = ()) -> DataFrame:
    """The table's key, performance, fingerprint, fate and refusal of every show asked for; nothing is changed.

    fate: a value or a column of shows. Refused are held shows unless `states` asks for them, shows that the table lacks, a fate that is
    unknown, and forgetting or suppressing without a performance. A show that is asked for twice is planned once (the
    smaller fate in the order of the alphabet if they differ). The fingerprint is what the show is now: what
    changes before the plan is applied isn't removed.
    """
    key = table.key
    rows = shows.withColumn("fate", F.lit(fate) if isinstance(fate, str) else fate)
    stay, held = split_held(rows, state, states)
    tagged = stay.withColumn("refusal", F.lit(None).cast("string")).unionByName(held.withColumn("refusal", F.lit("held")))
    one = tagged.groupBy(key).agg(F.min(F.struct("fate", F.col(performance).alias("performance"), "refusal")).alias("x")).select(key, "x.*")
    done = table.done()
    if done is None:
        done = one.select(key, F.lit(None).cast("string").alias("fingerprint")).limit(0)
    done = done.select(F.col(key).alias("__k"), "fingerprint")
    planned = one.join(done, F.col(key) == F.col("__k"), "left").drop("__k")
    known = F.col("fate").isin(UNTOUCHED, FORGET, SUPPRESS)
    why = F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("fingerprint").isNull(), "not in the library").when(~F.coalesce(known, F.lit(False)), "unknown fate").when((F.col("fate") != UNTOUCHED) & F.col("performance").isNull(), "no performance")
    return planned.select(key, "performance", "fingerprint", "fate", why.alias("refusal"))


def apply_removals(plan: DataFrame, table: Kept, ledger_path: str, schema: str, performance: str, status: str, position: str, tries: int = 5) -> DataFrame:
    """The key and outcome of every planned show: removed, or why not. The ledger's columns are named by performance, status and position.

    Shows are checked against the table again, and all that pass leave it in one commit, which holds only if no other commit came
    between (else they are checked anew). The ledger follows; a call that was cut off there is made good by
    the same call again, since shows that are gone already are forgotten or suppressed as planned, once.
    """
    key, spark = table.key, plan.sparkSession
    plan = checkpointed(plan)
    for attempt in range(tries):
        version = max(table.versions(), default=None)
        if version is None:
            return plan.select(key, F.coalesce("refusal", F.lit("gone already")).alias("outcome"))
        now = table.done(version).select(F.col(key).alias("__k"), F.col("fingerprint").alias("__now"))
        checked = plan.join(now, F.col(key) == F.col("__k"), "left")
        outcome = F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("__now").isNull(), "gone already").when(F.col("__now") != F.col("fingerprint"), "changed since the plan").otherwise("removed")
        checked = checkpointed(checked.select(key, F.col("performance"), "fate", outcome.alias("outcome")))
        going = checked.where("outcome = 'removed'")
        if going.isEmpty():
            break
        try:
            table.add(going.select(key, F.lit(None).cast("string").alias("fingerprint")), table.rows(version).limit(0), after=version)
            break
        except Moved:
            if attempt + 1 == tries:
                raise
    gone = checked.where("outcome in ('removed', 'gone already')")
    forgotten = gone.where(F.col("fate") == FORGET).select("performance")
    if not forgotten.isEmpty():
        sinks.forget_all(ledger_path, schema, performance, forgotten)
    hidden = gone.where(F.col("fate") == SUPPRESS)
    if not hidden.isEmpty():
        empty = spark.createDataFrame([], schema)
        rows = hidden.select(F.col("performance").alias(performance), F.lit(sinks.REJECTED).alias(status), F.lit(0).alias(position))
        rows = empty.unionByName(rows.select(*[F.col(c).cast(empty.schema[c].dataType) for c in rows.columns]), allowMissingColumns=True)
        sinks.record(ledger_path, rows, [performance, status], position)
    return checked.select(key, "outcome")
