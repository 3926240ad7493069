"""From items to a shortlist: search, group, gates, caps, assessments, choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions.text import contains_sequence, normalize_title
from stagewise.operators import catalog, ranking


def performances(items: DataFrame) -> DataFrame:
    """items: identifier, collection, date, venue, description, rating, reviews, pos. One row for each collection and date."""
    dated = items.where(F.coalesce("date", F.lit("")) != "").withColumn("date", F.substring("date", 1, 10))
    keys = ["collection", "date"]
    venue = ranking.majority(dated.withColumn("venue", F.nullif("venue", F.lit(""))), keys, "venue", "pos").drop("votes")
    grouped = dated.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "identifier"))).alias("recordings"), F.sum("reviews").alias("reviews"), F.coalesce(F.max("rating"), F.lit(0.0)).alias("rating"), F.collect_list(normalize_title(F.coalesce("description", F.lit("")))).alias("texts"))
    return grouped.join(venue, keys, "left").withColumn("performance_id", F.concat_ws("/", *keys))


def _any_has(texts: str, sequence: list[str]):
    return F.exists(texts, lambda t: contains_sequence(t, sequence))


def shortlist(items: DataFrame, history: list[DataFrame], assessments: DataFrame, *, min_rating: float = 3.5, min_reviews: int = 3, sequences: list[list[str]] | None = None, fetch: int = 40, count: int = 12, artist_cap: float = 1 / 3, year_cap: float = 1.0, floor: float = 6.0) -> DataFrame:
    """The shortlist with rank. assessments: performance_id, quality_score, pos (the last of an id counts)."""
    found = catalog.not_in_history(performances(items), "performance_id", *history)
    found = found.where((F.col("rating") >= min_rating) & (F.col("reviews") >= min_reviews))
    for s in sequences or []:
        found = found.where(_any_has("texts", s))
    found = found.withColumns({"o1": -F.col("reviews"), "o2": -F.col("rating"), "year": F.substring("date", 1, 4)})
    budgeted = ranking.capped_pick_two_axes(found, "collection", "year", ["o1", "o2", "performance_id"], fetch, artist_cap, year_cap).drop("pick")
    good = catalog.quality_floor(budgeted, assessments, "performance_id", "quality_score", floor, "pos")
    good = good.withColumn("o0", -F.col("quality_score"))
    return ranking.capped_pick_two_axes(good, "collection", "year", ["o0", "o1", "o2", "performance_id"], count, artist_cap, year_cap).withColumnRenamed("pick", "rank").drop("o0", "o1", "o2", "texts", "year")
