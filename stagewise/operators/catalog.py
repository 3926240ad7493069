"""Catalog: index, gates, resolution, history, state, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.text import artist_key, ascii_key
from stagewise.operators.ranking import argfirst

#: States from the least to the most advanced, and the order of a status report.
STATES = ["selected", "gathered", "researched", "vetted", "briefed", "packaged", "delivered", "held"]


def artist_index(artists: DataFrame, items: DataFrame, artist_id: str, item_artist: str, year: str, amount: str) -> DataFrame:
    """Each artist with recordings, downloads, year_min and year_max; artists without items stay; items of unknown artists don't count.

    item_artist may be an array (an item's collections): the item counts for each artist in it.
    """
    if items.schema[item_artist].dataType.typeName() == "array":
        items = items.withColumn(item_artist, F.explode(F.array_distinct(item_artist)))
    of = items.groupBy(F.col(item_artist).alias(artist_id)).agg(F.count(F.lit(1)).alias("recordings"), F.sum(amount).alias("downloads"), F.min(year).alias("year_min"), F.max(year).alias("year_max"))
    return artists.join(of, artist_id, "left").na.fill(0, ["recordings", "downloads"])


def artist_gate(index: DataFrame, min_recordings: int, min_downloads: int) -> DataFrame:
    """Enough recordings or enough downloads."""
    return index.where((F.col("recordings") >= min_recordings) | (F.col("downloads") >= min_downloads))


def resolve_names(asked: DataFrame, candidates: DataFrame, name: str, candidate: str) -> DataFrame:
    """Each asked name with the candidate that it equals (normalised), else the only one that contains it; n_options counts those that contain it.

    asked holds what a person typed: a few names, checked to be so, and broadcast to the candidates.
    """
    few = asked.select(F.col(name).alias("asked"), ascii_key(name).alias("__q")).limit(1001).collect()
    if len(few) > 1000:
        raise ValueError("at most 1000 names can be resolved at once")
    q = F.broadcast(asked.sparkSession.createDataFrame(few, "asked string, __q string"))
    pool = candidates.select(F.col(candidate).alias("found"), ascii_key(candidate).alias("__c"))
    hits = q.where("__q <> ''").join(pool, F.col("__c").contains(F.col("__q")))
    got = hits.groupBy("asked").agg(F.count(F.lit(1)).alias("n_options"), F.min(F.when(F.col("__c") == F.col("__q"), F.col("found"))).alias("__exact"), F.min("found").alias("__any"))
    got = q.select("asked").join(got, "asked", "left")
    return got.select("asked", F.coalesce(F.col("__exact"), F.when(F.col("n_options") == 1, F.col("__any"))).alias("resolved"), F.coalesce("n_options", F.lit(0)).alias("n_options"))


def family_artists(artists: DataFrame, name: str, evidence: DataFrame, evidence_name: str, extras: Sequence[str] = ()) -> DataFrame:
    """Artists whose key is among the evidence's keys or the extras."""
    keys = evidence.select(artist_key(evidence_name).alias("__key")).distinct()
    row = artists.withColumn("__k", artist_key(name))
    known = row.join(keys, F.col("__k") == F.col("__key"), "left_semi")
    if not extras:
        return known.drop("__k")
    more = row.where(F.col("__k").isin(list(extras))).join(keys, F.col("__k") == F.col("__key"), "left_anti")
    return known.unionByName(more).drop("__k")


def search_filter(items: DataFrame, collection: str, creator: str, date: str, *, in_collection=None, by=None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Collection, or else creator, and a date range whose open ends are 1900 and 2100; pushed down to the scan."""
    if in_collection is not None:
        items = items.where(F.col(collection) == in_collection)
    elif by is not None:
        items = items.where(F.col(creator) == by)
    return items.where(F.col(date).between(date_from or "1900-01-01", date_to or "2100-01-01"))


def not_in_history(df: DataFrame, key: str, *histories: DataFrame) -> DataFrame:
    """Rows whose key is in none of the histories (frames of one column)."""
    for h in histories:
        df = df.join(h.select(F.col(h.columns[0]).alias("__seen")), F.col(key) == F.col("__seen"), "left_anti")
    return df


def quality_floor(df: DataFrame, assessments: DataFrame, key: str, score: str, floor: float, position: str) -> DataFrame:
    """Rows with an assessment (the last one of a key counts) at or above the floor."""
    last = argfirst(assessments, [key], [F.col(position).desc()])
    return df.join(last, key).where(F.col(score) >= floor)


def latest_disposition(ledger: DataFrame, key: str, at: str, position: str, value: str) -> DataFrame:
    """Each key with its latest value; of equally late ones, the one written last."""
    return ledger.groupBy(key).agg(F.max(F.struct(at, position, value)).alias("b")).select(key, F.col(f"b.{value}").alias(value), F.col(f"b.{at}").alias(at), F.col(f"b.{position}").alias(position))


def append_once(ledger: DataFrame, new: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Rows of new that the ledger lacks, one for each key (the first)."""
    first = argfirst(new, keys, [F.col(position)])
    seen = ledger.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return first.join(seen, same, "left_anti")


def derive_state(reached: dict[str, Column]) -> Column:
    """The most advanced state whose condition holds; held beats all."""
    out = F.lit(None).cast("string")
    for s in STATES:
        if s in reached:
            out = F.when(reached[s], F.lit(s)).otherwise(out)
    return out


def state_rollup(df: DataFrame, run: str, state: str, states: Sequence[str]) -> DataFrame:
    """A row for each run with a count for each state."""
    return df.groupBy(run).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def refresh_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose number of rows changed, with both counts and the change."""
    a = old.groupBy(key).agg(F.count(F.lit(1)).alias("n_old"))
    b = new.groupBy(key).agg(F.count(F.lit(1)).alias("n_new"))
    both = a.join(b, key, "full_outer").na.fill(0, ["n_old", "n_new"])
    return both.where("n_old <> n_new").withColumn("delta", F.col("n_new") - F.col("n_old"))


def recent_or_open(df: DataFrame, keys: Sequence[str], state: str, at: Sequence[Column], n: int, closed: str = "delivered") -> DataFrame:
    """All open rows, and the n latest closed ones of each key."""
    place = F.row_number().over(Window.partitionBy(*keys, state).orderBy(*at))
    return df.withColumn("__n", place).where((F.col(state) != closed) | (F.col("__n") <= n)).drop("__n")


def in_inventory(answers: DataFrame, inventory: DataFrame, *keys: str) -> DataFrame:
    """Answers of a model that name what there is."""
    return answers.join(inventory.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), [F.col(k) == F.col(f"__{k}") for k in keys], "left_semi")
