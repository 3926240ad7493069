"""Census statistics of a catalog."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.shipping import checkpointed


def decades(items: DataFrame, year: str, amount: str, rating: str) -> DataFrame:
    """Items, rated share and medians by decade."""
    decade = F.concat((F.floor(F.col(year).cast("int") / 10) * 10).cast("string"), F.lit("s"))
    return items.groupBy(decade.alias("decade")).agg(F.count(F.lit(1)).alias("items"), F.avg(F.col(rating).isNotNull().cast("double")).alias("rated"), F.median(F.col(amount).cast("double")).alias("median_amount"))


def group_sizes(items: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups have how many items."""
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def rating_buckets(items: DataFrame, rating: str, width: float = 0.5) -> DataFrame:
    """Items by rating, in buckets of a width; unrated ones apart."""
    bucket = F.when(F.col(rating).isNull(), F.lit("unrated")).otherwise(F.format_string("%.1f", F.floor(F.col(rating) / width) * width))
    return items.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("items"))


def largest_format(files: DataFrame, item: str, kind: str, size: str) -> DataFrame:
    """item with the largest of its formats' total sizes."""
    by = files.groupBy(item, kind).agg(F.sum(size).alias("total"))
    return by.groupBy(item).agg(F.max("total").alias("largest"), F.count(F.lit(1)).alias("formats"))


def mean_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean with a 95 percent confidence interval."""
    agg = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"))
    half = 1.96 * F.col("__sd") / F.sqrt("n")
    return agg.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


#: Ranks read from a sketch: every hundredth.
GRID = 100


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, rank: float = 0.5, small: int = 100_000, size: int = 1000) -> DataFrame:
    """keys, n, quantile: the exact quantile of a stratum's values, between two of them as far as the rank lies between theirs.

    Nothing is sorted by stratum. Mergeable sketches (of `size` items, map-side) give an interval of about 4 percent of a stratum's values that holds the
    rank; counts prove it, and sketches of the interval's values narrow it on until it holds `small` values or no longer shrinks. Its
    values are then counted one by one. Null values and NaN don't count; a stratum without others has n 0 and a null quantile;
    null keys are a stratum.
    """
    keys = list(keys)
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v")).withColumn("__v", F.when(~F.isnan("__v"), F.col("__v")))
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    sketch = lambda inside: F.kll_sketch_agg_double(F.when(inside, F.col("__v")), F.lit(size))
    at = lambda c, name: F.col(f"{c}.{name}")

    def proposed(state: DataFrame) -> DataFrame:
        """state with next: the interval that the sketch of the values inside gives for the ranks, one step of the grid to spare."""
        marks = F.when(F.col("inside") > 0, F.kll_sketch_get_quantile_double("sketch", grid))
        step = lambda r, spare: F.greatest(F.lit(1), F.least(F.lit(GRID + 1), (F.floor((r - F.col("below")) / F.col("inside") * GRID) + 1 + spare).cast("int")))
        first, last = F.try_element_at("__m", step(F.col("first"), -1)), F.try_element_at("__m", step(F.col("last") + 1, 2))
        # the outer marks are the interval's own ends
        return state.withColumn("__m", marks).withColumns({"next_low": F.greatest("low", first), "next_high": F.least("high", last)}).drop("__m", "sketch")

    state = rows.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"), sketch(F.lit(True)).alias("sketch"))
    place = (F.col("n") - 1) * F.lit(rank)
    state = state.withColumns({"first": F.floor(place), "last": F.ceil(place), "below": F.lit(0).cast("long"), "inside": F.col("n")})
    state = checkpointed(proposed(state))
    while not state.where((F.col("inside") > small) & ((F.col("next_low") > F.col("low")) | (F.col("next_high") < F.col("high")))).isEmpty():
        tried = _within(rows, state, keys, "next_low", "next_high")
        inside = F.col("__v").between(F.col("s.next_low"), F.col("s.next_high"))
        found = tried.groupBy(*[at("s", k).alias(k) for k in keys]).agg(F.count_if(F.col("__v") < F.col("s.next_low")).alias("__below"), F.count_if(inside).alias("__inside"), sketch(inside).alias("sketch"))
        both = _same(state.alias("s"), found.alias("f"), keys, "left")
        holds = (at("f", "__below") <= at("s", "first")) & (at("s", "last") < at("f", "__below") + at("f", "__inside"))
        kept = lambda new, old: F.when(holds, new).otherwise(old)
        # an interval that misses the ranks is given up: the old one's values are counted
        state = both.select(*[at("s", k).alias(k) for k in keys], at("s", "n").alias("n"), at("s", "first").alias("first"), at("s", "last").alias("last"), kept(at("s", "next_low"), at("s", "low")).alias("low"), kept(at("s", "next_high"), at("s", "high")).alias("high"), kept(at("f", "__below"), at("s", "below")).alias("below"), kept(at("f", "__inside"), at("s", "inside")).alias("inside"), F.when(holds, F.col("f.sketch")).alias("sketch"))
        state = checkpointed(proposed(state))
    # values in the interval, equal ones combined before the shuffle
    counted = _within(rows, state, keys, "low", "high").where(F.col("__v").between(F.col("s.low"), F.col("s.high")))
    counted = counted.groupBy(*[at("s", k).alias(k) for k in keys], *[F.col(f"s.{c}").alias(c) for c in ("n", "first", "last", "below")], "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v")) + F.col("below")
    ends = counted.withColumn("__u", upto).groupBy(*keys).agg(F.min(F.when(F.col("__u") > F.col("first"), F.col("__v"))).alias("__a"), F.min(F.when(F.col("__u") > F.col("last"), F.col("__v"))).alias("__b"))
    out = _same(state.alias("s"), ends.alias("e"), keys, "left")
    part = (at("s", "n") - 1) * F.lit(rank) - at("s", "first")
    return out.select(*[at("s", k).alias(k) for k in keys], at("s", "n").alias("n"), (F.col("e.__a") + (F.col("e.__b") - F.col("e.__a")) * part).alias("quantile"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Frames named s and another name, joined where all keys are equal or null."""
    name = "f" if "__below" in right.columns else "e"
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"{name}.{k}"))
    return left.join(right, on, how)


def _within(rows: DataFrame, state: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """rows r with their stratum's state s: those up to the interval's end, without strata that have no values."""
    on = F.col("__v") <= F.col(f"s.{high}")
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    return rows.where("__v is not null").alias("r").join(state.alias("s"), on)


def stratum(c: str | Column, bounds: Sequence[float], missing: str) -> Column:
    """Name of a value's range among ascending bounds, such as '< 4', '4 - 10' and '10+'; missing ones apart."""
    c = F.col(c) if isinstance(c, str) else c
    name = F.when(c.isNull(), missing).when(c < bounds[0], f"< {bounds[0]:g}")
    for a, b in pairwise(bounds):
        name = name.when(c < b, f"{a:g} - {b:g}")
    return name.otherwise(f"{bounds[-1]:g}+")


def yearly(amount: str | Column, since: str | Column, today: str) -> Column:
    """Amount per year since a day, up to today; of less than a year, per one year."""
    amount, since = (F.col(c) if isinstance(c, str) else c for c in (amount, since))
    return amount / F.greatest(F.lit(1.0), F.datediff(F.lit(today).cast("date"), since.cast("date")) / 365.25)
