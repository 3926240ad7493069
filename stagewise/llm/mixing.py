"""Mixing sources to target weights, by hash-random keys and distributed prefix sums.

Every row gets a random key, a hash of its id and a seed; the key's leading part
is its bucket, so buckets are equal ranges of the sort order of each source.
Sizes are summed by (source, bucket) with map-side combining; a running sum over
the few buckets of a source gives the prefix sum at each bucket's start, and so
the one bucket that holds the cut. That bucket is divided again likewise. Rows in
buckets before the cut are taken whole, rows behind it are not, and only the
rows of the last cut bucket (a 1/buckets^2 share of the source) are sorted by
key and summed one by one, up to the exact budget. No source, however large, meets in one task and no text is
shuffled. Sources whose budget exceeds their size are taken in whole epochs
first.

Defined results: a null text has size 0; a null source is a source of its own,
the last; rows that repeat an id are ordered by their size; a source of size 0
has target 0; an empty table gives no rows; input columns named like results are
replaced by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import checkpointed, n_words, text_of, with_result

RESULTS = ("size", "source_size", "target", "taken")
#: Rows of the table of sources up to which it is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(skey, source_size) with target: share x all sizes dealt by weight, no source above cap x its size.

    Dealing the excess again and again ends where one level fits all: a source gets
    weight x level, or its cap if that is less. Sorted by cap / weight, the capped sources come first.
    The table has one row for each source.
    """
    rank = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"__all": F.sum("source_size").over(every) * F.lit(float(share)), "__w": F.sum("w").over(every), "__cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "__w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    t = t.withColumn("__level", (F.col("__all") - F.col("__cap_before")) / (F.col("__w") - F.col("__w_before")))
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("__level"), F.struct(F.col("cap") / F.col("w"), F.col("skey"), F.col("__level").alias("level")))).over(every)["level"]
    t = t.withColumn("__level", level)
    return t.select("skey", "source_size", F.coalesce(F.least("cap", F.col("__level") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, buckets: int = 1024, seed: str = "mix", carry: Sequence[str] | None = None) -> DataFrame:
    """Every row of docs with size (words), source_size, target and taken: the words of it that the mix takes, repeats counted."""
    keep = with_result(docs, docs.columns if carry is None else carry, RESULTS)
    key = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("long")
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in keep], F.col(id_col).alias("__id"), skey.alias("skey"), key.alias("key"), text_of(text_col).alias("__text"))
    # two levels of ranges of the keys: a bucket of the second is as many times smaller again
    rows = rows.withColumns({"bucket": F.floor(F.col("key") / F.lit(2**48 // buckets)).cast("int"), "fine": F.floor(F.col("key") / F.lit(2**48 // buckets**2)).cast("long")})

    sums = rows.select("skey", "bucket", n_words(F.col("__text")).alias("size")).groupBy("skey", "bucket").agg(F.sum("size").alias("size"))
    sums = checkpointed(sums)  # at most `buckets` rows for each source
    targets = source_targets(sums.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, cap)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("left", budget - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("end", F.sum("size").over(upto)).join(targets, "skey")
    # the cut lies in the first bucket whose end reaches what is left of the budget
    reached = F.col("end") >= F.col("left")
    cut = F.min(F.when(reached, F.struct("bucket", (F.col("end") - F.col("size")).alias("start"))))
    plan = ends.groupBy("skey").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("epochs"), F.first("left").alias("left"), cut.alias("cut"))
    plan = checkpointed(plan.select(F.col("skey").alias("__s"), "source_size", "target", "epochs", "left", F.col("cut.bucket").alias("cut"), F.col("cut.start").alias("cut_start")))
    small = plan.count() <= BROADCAST_SOURCES
    spread = lambda df: F.broadcast(df) if small else df
    # and there in the first of the second level
    inner = rows.join(spread(plan.select("__s", "cut")), (F.col("skey") == F.col("__s")) & (F.col("bucket") == F.col("cut")))
    inner = inner.select("skey", "fine", n_words(F.col("__text")).alias("size")).groupBy("skey", "fine").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("skey").orderBy("fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("__upto", F.sum("size").over(upto)).join(plan.select("__s", "left", "cut_start"), F.col("skey") == F.col("__s")).withColumn("end", F.col("cut_start") + F.col("__upto"))
    inner = inner.groupBy("__s").agg(F.min(F.when(reached, F.struct("fine", (F.col("end") - F.col("size")).alias("start")))).alias("in"))
    plan = checkpointed(plan.drop("cut", "cut_start").join(inner, "__s", "left").select("__s", "source_size", "target", "epochs", "left", F.col("in.fine").alias("cut"), F.col("in.start").alias("cut_start")))
    plan = spread(plan)
    rows = rows.join(plan, F.col("skey") == F.col("__s"))

    out = [*[F.col(f"c_{c}").alias(c) for c in keep], "size", "source_size", "target"]
    sized = lambda df: df.withColumn("size", n_words(F.col("__text")))
    whole = F.when(F.col("fine") < F.col("cut"), F.col("size")).otherwise(0)
    rest = sized(rows.where(~F.col("fine").eqNullSafe(F.col("cut"))))
    rest = rest.select(*out, (F.col("epochs") * F.col("size") + whole).alias("taken"))
    before = Window.partitionBy("skey").orderBy("key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = sized(rows.where(F.col("fine") == F.col("cut"))).withColumn("start", F.col("cut_start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("start")))
    at_cut = at_cut.select(*out, (F.col("epochs") * F.col("size") + part).alias("taken"))
    return rest.unionByName(at_cut)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy that is taken, with the columns of docs.

    Documents aren't torn: of the one document that a source's budget cuts, the copy stays if half of it or more is taken.
    """
    columns = [F.col(c).alias(f"__c{k}") for k, c in enumerate(docs.columns)]
    names = {k: options.pop(k, k.replace("_col", "")) for k in ("text_col", "source_col")} | {"id_col": options.pop("id_col", "doc_id")}
    at = {k: f"__c{docs.columns.index(c)}" for k, c in names.items()}
    mixed = mix(docs.select(*columns), **at, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    mixed = mixed.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    return mixed.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)])
