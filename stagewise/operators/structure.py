"""Set structure: breaks and labels, evidence, anchoring, contradictions, guards, segues, rank of parses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.text import artist_key, fuzzy_title, is_filler, normalize_title, same_song, title_parts, try_int
from stagewise.functions.titles import ALIASES, SHORTHAND
from stagewise.operators.ranking import argfirst


def set_breaks(tracks: DataFrame, show: str, index: str, label: str) -> DataFrame:
    """(show, after_track): the tracks behind which the set's label changes."""
    nxt = F.lead(label).over(Window.partitionBy(show).orderBy(index))
    return tracks.withColumn("__next", nxt).where(F.col("__next") != F.col(label)).select(show, F.col(index).alias("after_track"))


def labels_from_breaks(tracks: DataFrame, show: str, index: str, is_break: Column, encore_after: Column | None = None) -> DataFrame:
    """tracks with set_label: 1 and the number of breaks before the track; encore past encore_after."""
    before = Window.partitionBy(show).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(is_break.cast("int")).over(before), F.lit(0)) + 1
    label = n.cast("string")
    if encore_after is not None:
        label = F.when(F.col(index) > encore_after, F.lit("encore")).otherwise(label)
    return tracks.withColumn("set_label", label)


def invalid_overrides(overrides: DataFrame, n_tracks: str, breaks: str, encore_after: str) -> Column:
    """Reasons why a forced structure can't be applied: breaks and encore must lie inside, the encore past every break."""
    n, e = F.col(n_tracks), F.col(encore_after)
    bad = F.filter(breaks, lambda b: (b < 1) | (b >= n))
    return F.array_compact(F.array(F.when(F.size(bad) > 0, F.lit("set break out of range")), F.when((e < 1) | (e >= n), F.lit("encore out of range")), F.when((F.size(breaks) > 0) & (e <= F.array_max(breaks)), F.lit("encore not past the last set break"))))


#: The words of set numbers in evidence, and labels that mean the one set there is.
SET_NUMBERS = {"one": "1", "i": "1", "1": "1", "two": "2", "ii": "2", "2": "2", "three": "3", "iii": "3", "3": "3"}
SET_ORDINALS = {"first": "1", "second": "2", "third": "3"}
ONLY_SET = ("show", "set")


def set_label(c: str) -> Column:
    """1, 2, 3 or encore of an evidence label: 'Encore 2', 'Set: Two', 'First Set', 'ii', 'show'; null if it names none."""
    s = F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(" \t\n\r"))
    table = F.create_map(*[F.lit(x) for kv in (SET_NUMBERS | SET_ORDINALS).items() for x in kv])
    # the word behind 'set', or the whole label; an ordinal also before 'set'
    word = lambda x, k: F.get(F.split(x, r"[^\p{L}\p{N}_]+"), F.lit(k))
    behind = F.when(F.startswith(s, F.lit("set")), word(F.ltrim(F.substring(s, 4, 1 << 20), F.lit(" \t:")), 0))
    before = F.when(word(s, 0).isin(*SET_ORDINALS) & (word(s, 1) == "set"), word(s, 0))
    numbered = F.when(~behind.isin(*SET_ORDINALS), F.try_element_at(table, behind))
    return F.when(s.startswith("encore"), "encore").when(s.isin(*ONLY_SET), "1").otherwise(F.coalesce(numbered, F.try_element_at(table, before), F.try_element_at(table, s)))


def events_of(rows: DataFrame, artist: str, date: str, event: str, label: str, position: str, closer: str, number: str) -> DataFrame:
    """(artist_key, date, event, place, k, name, closer, song_count): evidence rows with a readable label and position.

    place: of the event among the date's, by its number (0 if unreadable); k: of the set in its event; song_count: since
    the set before, null for the first.
    """
    rows = rows.withColumns({"artist_key": artist_key(artist), "name": set_label(label), "__at": try_int(position)}).where("name is not null and __at is not null")
    by = Window.partitionBy("artist_key", date, event)
    order = by.orderBy("__at", F.col(closer))
    rows = rows.withColumns({"k": F.row_number().over(order), "song_count": F.col("__at") - F.lag("__at").over(order), "__number": F.coalesce(F.first(try_int(number)).over(order), F.lit(0))})
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("artist_key", date).orderBy("__number", event)))
    return rows.select("artist_key", F.col(date).alias("date"), F.col(event).alias("event"), "place", "k", "name", F.col(closer).alias("closer"), "song_count")


def events_of_recordings(recordings: DataFrame, events: DataFrame, recording: str, artist: str, date: str, text: str, description: str) -> DataFrame:
    """recordings with hits: places of the date's events that a recording belongs to; empty if none can be told.

    Early and late in its words decide where a date has two events; else the events with a closer among the words of the description.
    """
    said = F.concat(F.lit(" "), normalize_title(F.coalesce(F.col(description), F.lit("")), ALIASES), F.lit(" "))
    closer = F.concat(F.lit(" "), fuzzy_title("closer", ALIASES), F.lit(" "))
    e = events.select(F.col("artist_key").alias("__a"), F.col("date").alias("__d"), "place", closer.alias("__closer"))
    keys = recordings.withColumns({"__key": artist_key(artist), "__said": said})
    joined = keys.join(e, (F.col("__key") == F.col("__a")) & (F.col(date) == F.col("__d")), "left")
    joined = joined.groupBy(recording).agg(F.array_sort(F.collect_set(F.when((F.trim("__closer") != "") & F.contains("__said", "__closer"), F.col("place")))).alias("__heard"), F.coalesce(F.max("place"), F.lit(0)).alias("n_events"))
    rows = recordings.join(joined.withColumnRenamed(recording, "__r"), F.col(recording).eqNullSafe(F.col("__r"))).drop("__r")
    early, late = F.lower(F.col(text)).rlike(r"\bearly\b"), F.lower(F.col(text)).rlike(r"\blate\b")
    told = F.when(early & late, F.array(F.lit(1), F.lit(2))).when(early, F.array(F.lit(1))).when(late, F.array(F.lit(2)))
    return rows.withColumn("hits", F.coalesce(F.when(F.col("n_events") == 2, told), "__heard")).drop("__heard")


def evidence_index(rows: DataFrame, event: Sequence[str], position: str, value: str) -> DataFrame:
    """rows with song_count: the change of value since the event's previous row, null for the first."""
    return rows.withColumn("song_count", F.col(value) - F.lag(value).over(Window.partitionBy(*event).orderBy(position)))


def segue_blend(winner: DataFrame, other: DataFrame, show: str, title: str, position: str, segue: str) -> DataFrame:
    """winner's rows with blended: own segue, or that of the same occurrence of the title in other."""
    nth = F.row_number().over(Window.partitionBy(show, title).orderBy(position))
    b = other.withColumn("__n", nth).select(F.col(show).alias("__s"), F.col(title).alias("__t"), "__n", F.col(segue).alias("__segue"))
    a = winner.withColumn("__m", nth)
    joined = a.join(b, (F.col(show) == F.col("__s")) & (F.col(title) == F.col("__t")) & (F.col("__m") == F.col("__n")), "left")
    return joined.withColumn("blended", F.col(segue) | F.coalesce("__segue", F.lit(False))).drop("__s", "__t", "__n", "__m", "__segue")


def closer_candidates(tracks: DataFrame, closers: DataFrame, show: str, index: str, title: str, closer: str, position: str, name: str) -> DataFrame:
    """(show, position, name, closer, options, tier): the tracks that may be each set's closer, in order.

    A merged track closes on its last song, and so does a merged closer. Where a track has just the closer's
    name (tier exact), tracks with a similar one (tier fuzzy) don't count. A show's tracks and closers meet in one row.
    """
    last = lambda c: F.element_at(title_parts(c, SHORTHAND), -1)
    songs = tracks.groupBy(F.col(show).alias("__s")).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), last(title).alias("song")))).alias("__songs"))
    rows = closers.join(songs, F.col(show) == F.col("__s"), "left").withColumn("__want", last(closer))
    hits = lambda test: F.transform(F.filter("__songs", test), lambda x: x["i"])
    rows = rows.withColumns({"__exact": hits(lambda x: x["song"] == F.col("__want")), "__near": hits(lambda x: same_song(x["song"], F.col("__want")))})
    tier = F.when(F.size("__exact") > 0, "exact").when(F.size("__near") > 0, "fuzzy")
    options = F.when(tier == "exact", F.col("__exact")).when(tier == "fuzzy", F.col("__near")).otherwise(F.array().cast("array<int>"))
    return rows.select(show, position, name, closer, options.alias("options"), tier.alias("tier"))


def closer_contradictions(tracks: DataFrame, closers: DataFrame, show: str, index: str, label: str, title: str, closer: str, position: str, name: str) -> DataFrame:
    """Each closer with hits and verdict: missing (soft), not at a set break (hard; only where it hits one track), ambiguous or ok. Only of shows with tracks."""
    by = Window.partitionBy(show).orderBy(index)
    ends = tracks.withColumn("__next", F.lead(label).over(by)).where(F.col("__next").isNull() | (F.col("__next") != F.col(label)))
    ends = ends.groupBy(F.col(show).alias("__s")).agg(F.collect_set(F.col(index).cast("int")).alias("__ends"))
    found = closer_candidates(tracks, closers, show, index, title, closer, position, name).join(ends, F.col(show) == F.col("__s"))
    hits = F.size("options")
    verdict = F.when(hits == 0, "missing").when(hits > 1, "ambiguous").when(F.array_contains("__ends", F.get("options", F.lit(0))), "ok").otherwise("not at a set break")
    return found.select(show, position, closer, hits.cast("long").alias("hits"), verdict.alias("verdict"))


def resolve_positions(candidates: Column) -> Column:
    """One position for each list of candidates: the last list's largest, and before it each list's largest below its successor's; null if one has none."""
    start = F.struct(F.lit(2**31 - 1).alias("below"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, options: Column) -> Column:
        best = F.array_max(F.filter(options, lambda p: p < acc["below"]))
        return F.struct(F.coalesce(best, F.lit(-1)).cast("int").alias("below"), F.concat(F.array(best.cast("int")), acc["found"]).alias("found"))

    found = F.aggregate(F.reverse(candidates), start, step)["found"]
    return F.when((F.size(candidates) > 0) & ~F.exists(found, lambda p: p.isNull()), found)


def anchor_breaks(tracks: DataFrame, closers: DataFrame, show: str, index: str, title: str, closer: str, position: str, name: str, aligned: str | None = None) -> DataFrame:
    """tracks with anchored: the set's name, from the tracks that close the sets; only of shows where every set finds its closer in order.

    Tracks up to a set's closer belong to it, tracks behind the last one to the last set. Evidence often leaves the
    encore out or counts it to the last set: where no set is an encore, the tracks at the end that `aligned` calls so
    keep that, but for the last set's first track.
    """
    lists = closer_candidates(tracks, closers, show, index, title, closer, position, name)
    shows = lists.groupBy(show).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("k"), F.col(name).alias("set"), "options"))).alias("sets"))
    shows = shows.where(F.exists("sets", lambda s: s["set"] != "encore"))
    shows = shows.select(F.col(show).alias("__s"), F.transform("sets", lambda s: s["set"]).alias("__names"), resolve_positions(F.transform("sets", lambda s: s["options"])).alias("__ends")).where("__ends is not null")
    out = tracks.join(shows, F.col(show) == F.col("__s"))
    k = F.least(F.size(F.filter("__ends", lambda e: e < F.col(index))), F.size("__names") - 1)
    named = F.get("__names", k)
    if aligned is not None:
        whole = Window.partitionBy(show)
        # the last track that isn't an encore, and the first track of the last set
        out = out.withColumns({"__music": F.max(F.when(F.coalesce(F.col(aligned), F.lit("")) != "encore", F.col(index))).over(whole), "__from": F.min(F.when(F.col(index) > F.coalesce(F.get("__ends", F.size("__ends") - 2), F.lit(-1)), F.col(index))).over(whole)})
        restored = (F.col(index) > F.coalesce("__music", F.lit(-1))) & (F.col(index) > F.col("__from")) & ~F.array_contains("__names", "encore")
        named = F.when(restored, "encore").otherwise(named)
    return out.withColumn("anchored", named).drop("__s", "__names", "__ends", "__music", "__from")


def structure_guard(shows: DataFrame, *, sets: str, breaks: str, seconds: str, expected: str, evidence_sets: str, most_minutes: int = 150) -> Column:
    """The first thing that is wrong with a show's structure, or null."""
    minutes = F.col(seconds) / 60
    return (
        F.when(F.col(expected).isNotNull() & (F.col(expected) != F.col(sets)), F.concat(F.lit("expected "), F.col(expected).cast("string"), F.lit(" sets, found "), F.col(sets).cast("string")))
        .when(F.col(breaks) > 0, F.lit(None).cast("string"))
        .when(F.coalesce(F.col(evidence_sets), F.lit(0)) > 1, F.lit("evidence has several sets, tracks have no break"))
        .when(minutes >= most_minutes, F.concat(F.bround(minutes, 0).cast("long").cast("string"), F.lit(" minutes without a set break")))
    )


def event_partition(rows: DataFrame, collection: Column, date: Column, n_events: Column, text: Column, hit_event: Column) -> Column:
    """Performance id of a recording: with one event the plain id; with two or more the event its words or closers name; with none, what its text says."""
    base = F.concat_ws("/", collection, date)
    early, late = text.rlike(r"\bearly\b"), text.rlike(r"\blate\b")
    two = F.when(early & late, "spans").when(early, "e1").when(late, "e2").when(hit_event.isNotNull(), F.concat(F.lit("e"), hit_event.cast("string"))).otherwise("unassigned")
    more = F.when(hit_event.isNotNull(), F.concat(F.lit("e"), hit_event.cast("string"))).otherwise("unassigned")
    sniff = F.when(early & ~late, "early").when(late & ~early, "late")
    kind = F.when(n_events == 1, F.lit(None).cast("string")).when(n_events == 2, two).when(n_events > 2, more).otherwise(sniff)
    return F.concat_ws("/", base, kind)


def parse_rank(parses: DataFrame, show: str, *, official: Column, length: str, confidence: str, multi_set: Column, target: str, position: str) -> DataFrame:
    """The best parse of each show: an official source, then a plausible length, confidence, several sets, nearness to the target, the first."""
    least = F.least(F.col(target), F.greatest(F.lit(5), F.floor(F.col(target) / 2)))
    trust = F.when(F.col(confidence) == "high", 2).when(F.col(confidence) == "medium", 1).otherwise(0)
    order = [official.desc(), (F.col(length) >= least).desc(), trust.desc(), multi_set.desc(), F.abs(F.col(length) - F.col(target)).asc(), F.col(position).asc()]
    return argfirst(parses, [show], order)


def from_setlist_service(raw: DataFrame, show: str, sets: str) -> DataFrame:
    """(show, pos, title, set_label) from array<struct<encore, song: array<struct<name, tape>>>>; tapes and blanks don't count; five songs at least."""
    each = raw.select(show, F.posexplode(sets).alias("k", "s"))
    numbered = F.count_if(F.col("s.encore").isNull()).over(Window.partitionBy(show).orderBy("k"))
    each = each.withColumn("set_label", F.when(F.col("s.encore").isNotNull(), "encore").otherwise(numbered.cast("string")))
    songs = each.select(show, "k", "set_label", F.posexplode("s.song").alias("j", "song")).where((F.trim("song.name") != "") & ~F.coalesce("song.tape", F.lit(False)))
    by = Window.partitionBy(show)
    return songs.withColumns({"pos": F.row_number().over(by.orderBy("k", "j")), "__n": F.count(F.lit(1)).over(by)}).where("__n >= 5").select(show, "pos", F.col("song.name").alias("title"), "set_label")


def applied_alignment(tracks: DataFrame, answers: DataFrame, show: str, index: str, title: str, label: str, segue: str, matched_title: str) -> DataFrame:
    """tracks with set_label, segue, matched and the show's coverage, as a model's answer says; only of shows whose answer names each track once, with known sets.

    answers: (show, index, label, segue, matched_title).
    """
    a = answers.select(F.col(show).alias("__s"), F.col(index).alias("__i"), F.col(label).alias("set_label"), F.coalesce(segue, F.lit(False)).alias("segue"), (F.coalesce(matched_title, F.lit("")) != "").alias("matched"))
    sizes = tracks.groupBy(F.col(show).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    said = a.groupBy("__s").agg(F.count(F.lit(1)).alias("__rows"), F.array_sort(F.collect_set("__i")).alias("__all"), F.bool_and(F.coalesce(F.col("set_label").isin("1", "2", "3", "encore"), F.lit(False))).alias("__valid"))
    whole = sizes.join(said, F.col("__t") == F.col("__s")).where("__rows = __n and __valid").where(F.size("__all") == F.col("__n")).where((F.array_min("__all") == 1) & (F.array_max("__all") == F.col("__n"))).select(F.col("__t").alias("__ok"))
    rows = tracks.join(whole, F.col(show) == F.col("__ok")).join(a, (F.col(show) == F.col("__s")) & (F.col(index) == F.col("__i")))
    song = ~is_filler(title)
    share = F.coalesce(F.avg(F.when(song, F.col("matched").cast("double"))).over(Window.partitionBy(show)), F.lit(0.0))
    return rows.withColumn("coverage", share).drop("__s", "__i", "__ok")
