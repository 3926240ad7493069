"""The library of shows: selection, order, and small look-ups around it."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.operators.catalog import STATES


def selected(shows: DataFrame, *, state: str, artist: str, run: str, states: Collection[str] = (), artist_like: str = "", run_is: str = "") -> DataFrame:
    """Shows in one of the states, whose artist has the words in any case, of the run; what is empty doesn't count."""
    tests = [F.col(state).isin(*states) if states else None, F.contains(F.lower(F.coalesce(F.col(artist), F.lit(""))), F.lit(artist_like.lower())) if artist_like else None, F.col(run) == run_is if run_is else None]
    for test in tests:
        shows = shows if test is None else shows.where(test)
    return shows


def split_held(shows: DataFrame, state: str, states: Collection[str] = (), held: str = "held") -> tuple[DataFrame, DataFrame]:
    """(shows to act on, held shows that are left out): none is left out where held ones were asked for."""
    if held in states:
        return shows, shows.limit(0)
    is_held = F.coalesce(F.col(state) == held, F.lit(False))
    return shows.where(~is_held), shows.where(is_held)


def state_order(state: str | Column) -> Column:
    """Place of a state in the order of work, from 1; unknown ones last."""
    c = F.col(state) if isinstance(state, str) else state
    place = F.array_position(F.array(*map(F.lit, STATES)), c)
    return F.when(place > 0, place).otherwise(len(STATES) + 1)


def considered(recordings: DataFrame, key: str, identifier: str, chosen: str, score: str) -> DataFrame:
    """The recordings that weren't chosen, with rank by score."""
    rest = recordings.where(~F.col(identifier).eqNullSafe(F.col(chosen))).withColumn(score, F.coalesce(score, F.lit(0.0)))
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), identifier)))


def deepest(index: DataFrame, recordings: str, title: str, n: int) -> DataFrame:
    """The n artists with the most recordings."""
    return index.orderBy(F.col(recordings).desc(), title).limit(n)


def excluded_files(tokens: DataFrame, tracks: DataFrame, show: str, token: str, index: str, name: str) -> DataFrame:
    """show, token, filename: what is to be left out of each show; groups with commas are split, numbers are tracks, all else is a file's name.

    A number without a track has no filename: the caller refuses those.
    """
    each = tokens.select(show, F.explode(F.split(token, ",")).alias("token")).withColumn("token", F.trim("token")).where("token <> ''")
    number = F.when(F.col("token").rlike(r"^\d+$"), F.col("token").try_cast("long"))
    t = tracks.select(F.col(show).alias("__s"), F.col(index).cast("long").alias("__i"), F.col(name).alias("__n"))
    rows = each.withColumn("__k", number).join(t, (F.col(show) == F.col("__s")) & (F.col("__k") == F.col("__i")), "left")
    return rows.select(show, "token", F.when(F.col("__k").isNotNull(), F.col("__n")).otherwise(F.col("token")).alias("filename"))


def assigned(packages: DataFrame, assignments: DataFrame, profile: str, presenter: str, title: str, default: str | None) -> DataFrame:
    """packages with presenter and title: those of their profile's assignment; else the default presenter without a title, else none."""
    a = assignments.select(F.col(profile).alias("__p"), F.col(presenter).alias("__who"), F.col(title).alias("__what"))
    rows = packages.join(a, F.col(profile) == F.col("__p"), "left")
    found = F.col("__p").isNotNull()
    return rows.withColumns({"presenter": F.when(found, F.col("__who")).otherwise(F.lit(default)), "title": F.when(found, F.col("__what"))}).drop("__p", "__who", "__what")


def in_use(assignments: DataFrame, presenters: DataFrame, presenter: str) -> DataFrame:
    """Presenters that an assignment names: they can't be removed."""
    return presenters.join(assignments.select(F.col(presenter).alias("__p")).distinct(), F.col(presenter) == F.col("__p"), "left_semi")


def events_at(shows: DataFrame, events: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """shows with events: the values of all events with the same keys, in order; empty without any."""
    e = events.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("events"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    return shows.join(e, on, "left").drop(*[f"__{k}" for k in keys]).withColumn("events", F.coalesce("events", F.array().cast(e.schema["events"].dataType)))


def titles_by_cascade(entries: DataFrame, manifest: DataFrame, key: str, *titles: str) -> DataFrame:
    """entries with manifest columns of the same key; title: the first that isn't blank of the named columns."""
    m = manifest.select(F.col(key).alias("__k"), *[c for c in manifest.columns if c != key])
    rows = entries.join(m, F.col(key) == F.col("__k"), "left").drop("__k")
    return rows.withColumn("title", F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in titles]))


def place_of(shows: DataFrame, venue: str, city: str, known_venue: str, known_city: str, forced: str | None = None) -> DataFrame:
    """shows with venue, city and venue_source: as they are, from evidence where the venue is blank, or as forced."""
    blank = F.trim(F.coalesce(F.col(venue), F.lit(""))) == ""
    filled = blank & F.col(known_venue).isNotNull()
    out = shows.withColumns({venue: F.when(filled, F.col(known_venue)).otherwise(F.col(venue)), city: F.when(filled, F.col(known_city)).otherwise(F.col(city)), "venue_source": F.when(filled, "evidence").otherwise("item")})
    if forced:
        said = F.col(forced).isNotNull()
        out = out.withColumns({venue: F.coalesce(F.col(forced), F.col(venue)), "venue_source": F.when(said, "override").otherwise(F.col("venue_source"))})
    return out


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays have the same members, each once."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
