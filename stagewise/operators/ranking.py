"""Ranking: first of equals, capped picks, batches, keep-last.

Lists have no order here, so every order ends with columns that make it total.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argfirst(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order. The filter on row_number() lets Spark cut groups before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank within keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key in the (descending) order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def majority(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """keys with the most frequent non-null value; of equally frequent ones, the one that came first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("__first"))
    best = counted.groupBy(*keys).agg(F.min(F.struct(-F.col("votes"), F.col("__first"), F.col(value).alias("value"), F.col("votes").alias("votes"))).alias("b"))
    return best.select(*keys, F.col("b.value").alias(value), F.col("b.votes").alias("votes"))


def most_per_bucket(n: int, cap: float) -> int:
    return n if cap >= 1 else max(1, math.ceil(n * cap))


def capped_pick(df: DataFrame, bucket: str, order: Sequence[Column], n: int, cap: float) -> DataFrame:
    """n rows in order, no bucket above ceil(n x cap) while others have rows; slots still free then go to the best left. Adds pick, from 1."""
    per = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    rows = df.withColumn("__per", per).where(F.col("__per") <= n).withColumn("__over", F.col("__per") > most_per_bucket(n, cap))
    top = rows.orderBy("__over", *order).limit(n)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("__over", *order)).cast("long")).drop("__per", "__over")


def capped_pick_two_axes(df: DataFrame, artist: str, year: str, order: Sequence[str], n: int, cap: float, year_cap: float) -> DataFrame:
    """Artists get slots in score order, up to ceil(n x cap) each; each slot takes the next row of the artist's own queue, which is capped by year.

    order: column names, best first when ascending.
    """
    if len(df.select(artist).distinct().take(2)) < 2:
        return capped_pick(df, year, [F.col(c) for c in order], n, year_cap)
    cols = [F.col(c) for c in order]
    most = most_per_bucket(n, cap)
    of_artist = Window.partitionBy(artist)
    rows = df.withColumns({"__count": F.count(F.lit(1)).over(of_artist), "__slot": F.row_number().over(of_artist.orderBy(*cols)), "__in_year": F.row_number().over(Window.partitionBy(artist, year).orderBy(*cols))})
    year_most = F.lit(2**31) if year_cap >= 1 else F.greatest(F.lit(1), F.ceil(F.col("__count") * F.lit(year_cap)))
    rows = rows.withColumn("__queue", F.row_number().over(of_artist.orderBy(F.col("__in_year") > year_most, *cols)))
    # a slot has the order of the artist's row that won it
    slots = rows.where(F.col("__slot") <= most).select(F.col(artist).alias("__a"), F.col("__slot").alias("__s"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    placed = rows.join(slots, (F.col(artist) == F.col("__a")) & (F.col("__queue") == F.col("__s")), "left")
    late = F.col("__s").isNull()
    keys = [F.when(late, F.col(c)).otherwise(F.col(f"__o{k}")).alias(f"__k{k}") for k, c in enumerate(order)]
    placed = placed.select(*df.columns, late.alias("__late"), *keys)
    by = ["__late", *[f"__k{k}" for k in range(len(order))]]
    top = placed.orderBy(*by).limit(n)
    return top.withColumn("pick", F.row_number().over(Window.orderBy(*by)).cast("long")).select(*df.columns, "pick")


def choose_entries(df: DataFrame, approved: str, rank: str, bucket: str, n: int, human_gate: bool, cap: float) -> DataFrame:
    """Approved entries, first n, uncapped; without any and with the gate, none; else a capped pick of those not rejected; by rank."""
    any_yes = F.broadcast(df.agg(F.coalesce(F.bool_or(approved), F.lit(False)).alias("__any")))  # one row
    rows = df.join(any_yes)
    yes = rows.where(F.col("__any") & F.col(approved)).orderBy(rank).limit(n).select(*df.columns)
    if human_gate:
        return yes
    open_ones = rows.where(~F.col("__any") & F.coalesce(F.col(approved), F.lit(True))).select(*df.columns)
    return yes.unionByName(capped_pick(open_ones, bucket, [F.col(rank)], n, cap).drop("pick")).orderBy(rank)


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Adds batch, from 0: rows of a key in order, size at a time."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("batch", F.floor((n - 1) / size).cast("long"))
