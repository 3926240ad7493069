"""Redo and resumption bound to the test tables, each with SQL that gives the same rows.

A show is a customer with orders; what happens to a show are the events of the user of that number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.operators import removals, stages
from stagewise.plans.registry import literal, query, t, values
from stagewise.shipping import checkpointed, shared_folder
from stagewise.sources import settings
from stagewise.streaming import station

ORDER = [*stages.RUN_STAGES, *stages.SHOW_STAGES]
EDGES = list(zip(ORDER, ORDER[1:], strict=False)) + [("gather", "vet"), ("gather", "brief"), ("select", "package")]
#: Orders from that day on came after the first run.
SINCE = "1998-01-01"


def changes(spark, d):
    """show_id, stage: an event changes a stage of its user's show, by its id."""
    names = F.array(*map(F.lit, ORDER))
    return t(spark, d, "events").select(F.col("user_id").alias("show_id"), F.element_at(names, (F.col("event_id") % len(ORDER) + 1).cast("int")).alias("stage"))


CHANGES = f"changes AS (SELECT user_id AS show_id, {literal(ORDER)}[CAST(event_id % {len(ORDER)} + 1 AS INT)] AS stage FROM events)"
CLOSURE = f"""RECURSIVE edges AS {values('before, after', EDGES)},
later_of AS (
  SELECT DISTINCT s AS stage, s AS later FROM (SELECT before AS s FROM edges UNION SELECT after FROM edges)
  UNION SELECT l.stage, e.after FROM later_of l JOIN edges e ON e.before = l.later)"""


@query(f"""WITH {CLOSURE}, {CHANGES}
SELECT DISTINCT show_id, later AS stage FROM changes JOIN later_of USING (stage) WHERE later <> '{stages.KEPT}' OR later = stage""")
def redo_closure(spark, d):
    """All (show_id, stage) that the changes make stale; research is kept unless it changed itself."""
    edges = spark.createDataFrame(EDGES, "before string, after string")
    return stages.touched(changes(spark, d), edges, "show_id", "stage", [stages.KEPT])


def orders(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("show_id"), "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")


def before(spark, d):
    """What the first run saw: earlier orders, and some shows that are gone since."""
    gone = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("show_id"), F.lit(-1).cast("long").alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit(SINCE).cast("timestamp").alias("o_orderdate"), F.lit("O").alias("o_orderstatus"))
    rows = orders(spark, d)
    return rows.where(F.col("o_orderdate") < F.lit(SINCE)).unionByName(gone.join(rows.select("show_id").distinct(), "show_id", "left_anti").select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]))


@query(f"""WITH s AS (SELECT o_custkey AS show_id, count(*) FILTER (WHERE o_orderdate < DATE '{SINCE}') AS old, count(*) AS n FROM orders GROUP BY 1)
SELECT show_id, CASE WHEN old = 0 THEN 'new' ELSE 'changed' END AS reason FROM s WHERE old < n
UNION ALL SELECT c_custkey, 'gone' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def stale_shows(spark, d):
    """Shows whose inputs aren't those of the first run, and why."""
    now, done = (stages.fingerprints("show_id", [rows]) for rows in (orders(spark, d), before(spark, d)))
    return stages.stale(now, done, "show_id")


@query(f"""WITH s AS (
  SELECT o_custkey AS show_id, count(*) AS orders, max(o_orderdate) AS last, bool_or(o_orderdate >= DATE '{SINCE}') AS anew,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
         count(*) FILTER (WHERE o_orderdate < DATE '{SINCE}' AND o_orderstatus = 'F') AS finished_before,
         count(*) FILTER (WHERE o_orderdate < DATE '{SINCE}') AS before
  FROM orders GROUP BY 1)
SELECT show_id, orders, finished, anew, (before = 0 OR finished <> finished_before) AS finished_anew FROM s""")
def resumed_flow(spark, d):
    """Two runs of a flow of two stages: the second one computes just the shows with other inputs, in each stage.

    The second stage sees finished orders only: where these are the same, it isn't run.
    """
    root = shared_folder(spark, "flow")

    def flow(run: int) -> stages.Flow:
        count = lambda rows: rows.groupBy("show_id").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")).withColumn("run", F.lit(run))
        mark = lambda rows: rows.select("show_id", "finished", F.lit(run).alias("run"))
        return stages.Flow(spark, root, "show_id", [stages.Stage("gather", ["orders"], count), stages.Stage("finished", ["closed"], mark)])

    def run(k: int, rows):
        closed = rows.groupBy("show_id").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
        return flow(k).run({"orders": rows, "closed": closed})

    run(1, before(spark, d))
    out = run(2, orders(spark, d))
    finished = out["finished"].select("show_id", (F.col("run") == 2).alias("finished_anew"))
    return out["gather"].select("show_id", "orders", "finished", (F.col("run") == 2).alias("anew")).join(finished, "show_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def streamed_dispositions(spark, d):
    """The latest event of every user, by a stream that meets the events in three batches without order, the last of them again."""
    root = shared_folder(spark, "dispositions")
    rows = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    again = rows.where(F.col("event_id") % 5 == 0)
    rows.unionByName(again).repartition(6, F.xxhash64("event_id", "ts")).write.parquet(f"{root}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/rows")
    changed = station.latest_stream(stream, "user_id", ["ts", "event_id"], "event_type")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/changed/batch={number}")
    changed.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(changed.schema).parquet(f"{root}/changed")
    return station.latest_by_key(kept, "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT c_custkey AS file, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name,
       CASE WHEN c_custkey % 5 IN (0, 3) THEN NULL ELSE c_mktsegment END AS query,
       CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 3 END AS min_reviews, CASE WHEN c_custkey % 5 IN (0, 2) THEN 1 ELSE c_nationkey END AS count,
       CASE c_custkey % 5 WHEN 0 THEN 'no TOML' WHEN 2 THEN 'count: no int' WHEN 3 THEN 'criteria.query is missing'
         ELSE CASE WHEN c_acctbal <= 0 OR c_acctbal > 5000 THEN 'artist_cap isn''t above 0 and up to 1' END END AS error
FROM customer""")
def profile_rules(spark, d):
    """Profiles whose texts are written from customers, some of them with faults, and read back."""
    kind = F.col("c_custkey") % 5
    name = F.format_string('name = "%s"\n', "c_name")
    number = F.concat(F.lit("count = "), F.when(kind == 2, F.lit('"many"')).otherwise(F.col("c_nationkey").cast("string")), F.lit("\n"))
    words = F.when(kind == 3, F.lit("")).otherwise(F.format_string('query = "%s"\n', "c_mktsegment"))
    cap = F.concat(F.lit("artist_cap = "), (F.col("c_acctbal") / 5000).cast("decimal(12,8)").cast("string"), F.lit("\n"))
    text = F.when(kind == 0, F.concat(F.lit('name = "'), F.col("c_name"))).otherwise(F.concat(name, number, F.lit("[criteria]\n"), words, cap))
    rows = settings.profiles(t(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey")
    error = F.when(F.startswith("error", F.lit("no TOML")), "no TOML").otherwise(F.col("error"))
    return rows.select("file", "name", F.col("criteria.query").alias("query"), F.coalesce("criteria.min_reviews", F.lit(0)).alias("min_reviews"), "count", error.alias("error"))


#: Orders as shows to remove: what becomes of their history, and the state, in turn.
FATES, KINDS = [removals.UNTOUCHED, removals.FORGET, removals.SUPPRESS, "burn"], ["held", "ready", "packaged", "delivered", "ready"]
LEDGER = "performance string, status string, pos long"


def shelf(spark, d):
    """A library of the even orders, a ledger that knows all orders, and the wish to remove two of three orders."""
    root = shared_folder(spark, "shelf")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select("o_orderkey", F.when(k % 11 > 0, F.concat(F.lit("p"), k.cast("string"))).alias("performance"), pick(KINDS, k).alias("state"), pick(FATES, F.floor(k / 3)).alias("fate"), "o_totalprice")
    table = stages.Kept(spark, f"{root}/shows", "o_orderkey")
    held = o.where(k % 2 == 0)
    table.add(stages.fingerprints("o_orderkey", [held]), held)
    o.where("performance is not null").select("performance", F.lit("selected").alias("status"), k.alias("pos")).write.json(f"{root}/ledger")
    return o, table, f"{root}/ledger", o.where(k % 3 > 0)


WISHES = f"""o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN 'p' || o_orderkey END AS performance, {literal(KINDS)}[CAST(o_orderkey % {len(KINDS)} + 1 AS INT)] AS state, {literal(FATES)}[CAST(o_orderkey // 3 % {len(FATES)} + 1 AS INT)] AS fate FROM orders),
plan AS (SELECT *, CASE WHEN state = 'held' THEN 'held' WHEN o_orderkey % 2 > 0 THEN 'not in the library' WHEN fate = 'burn' THEN 'unknown fate' WHEN fate <> 'untouched' AND performance IS NULL THEN 'no performance' END AS refusal FROM o WHERE o_orderkey % 3 > 0)"""


@query(f"WITH {WISHES} SELECT o_orderkey, performance, fate, refusal FROM plan")
def removal_plan(spark, d):
    """What would be removed, what becomes of its history, and what is refused, without a change."""
    _, table, _, wish = shelf(spark, d)
    return removals.removal_plan(wish, table, "performance", "state", F.col("fate")).select("o_orderkey", "performance", "fate", "refusal")


@query(f"""WITH {WISHES}
SELECT o.o_orderkey, o.o_orderkey % 2 = 0 AND NOT (p.o_orderkey IS NOT NULL AND refusal IS NULL AND o.o_orderkey % 7 > 0) AS on_shelf,
  CASE WHEN refusal IS NOT NULL THEN refusal WHEN o.o_orderkey % 7 = 0 AND p.o_orderkey IS NOT NULL THEN 'changed since the plan' WHEN p.o_orderkey IS NOT NULL THEN 'removed' END AS outcome,
  CASE WHEN o.performance IS NULL THEN '' WHEN p.o_orderkey IS NULL OR refusal IS NOT NULL OR o.o_orderkey % 7 = 0 OR o.fate = 'untouched' THEN 'selected' WHEN o.fate = 'forget' THEN '' ELSE 'rejected,selected' END AS history
FROM o LEFT JOIN plan p ON p.o_orderkey = o.o_orderkey""")
def removed_shows(spark, d):
    """The library and the ledger after a plan was applied, twice; every seventh order changed between plan and application."""
    o, table, ledger, wish = shelf(spark, d)
    plan = checkpointed(removals.removal_plan(wish, table, "performance", "state", F.col("fate")))
    moved = table.rows().where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    table.add(stages.fingerprints("o_orderkey", [moved]), moved)
    outcome = removals.apply_removals(plan, table, ledger, LEDGER, "performance", "status", "pos")
    removals.apply_removals(plan, table, ledger, LEDGER, "performance", "status", "pos")
    left = table.rows().select(F.col("o_orderkey").alias("__l"))
    said = spark.read.schema(LEDGER).json(ledger).groupBy(F.col("performance").alias("__p")).agg(F.array_join(F.array_sort(F.collect_list("status")), ",").alias("history"))
    rows = o.join(left, F.col("o_orderkey") == F.col("__l"), "left").join(outcome, "o_orderkey", "left").join(said, F.col("performance") == F.col("__p"), "left")
    return rows.select("o_orderkey", F.col("__l").isNotNull().alias("on_shelf"), "outcome", F.coalesce("history", F.lit("")).alias("history"))
