"""Manifests, playlists, chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_durations(tracks: DataFrame, show: str, label: str, seconds: str) -> DataFrame:
    """Seconds of each set, a null counting 0, and of each show (a row with a null label)."""
    rolled = tracks.rollup(show, label).agg(F.sum(F.coalesce(seconds, F.lit(0))).alias("seconds"), F.count(F.lit(1)).alias("tracks"), F.grouping_id().alias("__g"))
    return rolled.where("__g < 3").drop("__g")


def manifest(tracks: DataFrame, show: str, index: str, label: str, title: str, seconds: str) -> DataFrame:
    """(show, manifest): a JSON document with tracks in order, set breaks, and seconds by set and in all."""
    nxt = F.lead(label).over(Window.partitionBy(show).orderBy(index))
    rows = tracks.withColumn("__break", F.when(nxt != F.col(label), F.col(index)))
    by = rows.groupBy(show, label).agg(F.sum(F.coalesce(seconds, F.lit(0))).alias("s"))
    sets = by.groupBy(show).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("s"))))).alias("set_durations_sec"))
    doc = rows.groupBy(show).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("index"), F.col(label).alias("set"), F.col(title).alias("title")))).alias("tracks"), F.array_sort(F.array_compact(F.collect_list("__break"))).alias("set_breaks"), F.sum(F.coalesce(seconds, F.lit(0))).alias("total_duration_sec"))
    doc = doc.join(sets, show)
    return doc.select(show, F.to_json(F.struct(F.lit(3).alias("schema_version"), "tracks", F.transform("set_breaks", lambda b: F.struct(b.alias("after_track"))).alias("set_breaks"), "set_durations_sec", "total_duration_sec")).alias("manifest"))


def interleave(tracks: DataFrame, show: str, index: str, label: str, filename: str) -> DataFrame:
    """(show, seq, kind, entry): each set's intro before its first track, tracks in order, the outro last."""
    first = F.row_number().over(Window.partitionBy(show, label).orderBy(index)) == 1
    rows = tracks.withColumn("__first", first)
    intro = rows.where("__first").select(show, F.col(index).alias("__i"), F.lit(0).alias("__o"), F.lit("intro").alias("kind"), F.concat(F.lit("intro-"), F.col(label)).alias("entry"))
    track = rows.select(show, F.col(index).alias("__i"), F.lit(1).alias("__o"), F.lit("track").alias("kind"), F.col(filename).alias("entry"))
    outro = rows.groupBy(show).agg(F.max(index).alias("__i")).select(show, "__i", F.lit(2).alias("__o"), F.lit("outro").alias("kind"), F.lit("outro").alias("entry"))
    every = intro.unionByName(track).unionByName(outro)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy(show).orderBy("__i", "__o")).cast("long")).drop("__i", "__o")


def m3u(entries: DataFrame, show: str, seq: str, entry: str) -> DataFrame:
    """(show, text): the playlist's file."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(seq, entry))), lambda x: x[entry])
    return entries.groupBy(show).agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def chapter_offsets(tracks: DataFrame, show: str, index: str, seconds: str) -> DataFrame:
    """tracks with start_ms and end_ms: running sums of milliseconds, rounded half to even track by track."""
    ms = F.bround(F.col(seconds) * 1000, 0).cast("long")
    upto = Window.partitionBy(show).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tracks.withColumn("end_ms", F.sum(ms).over(upto))
    return rows.withColumn("start_ms", F.col("end_ms") - ms)


def stream_copy(tracks: DataFrame, show: str, codec: str, rate: str, channels: str) -> DataFrame:
    """show with eligible: all mp3, one rate, one number of channels."""
    return tracks.groupBy(show).agg(((F.count_if(F.col(codec) != "mp3") == 0) & (F.count_distinct(rate) == 1) & (F.count_distinct(channels) == 1)).alias("eligible"))


def review_digest(reviews: DataFrame, key: str, position: str, body: str, limit: int = 5, width: int = 800) -> DataFrame:
    """key with digest: the first reviews, cut to a width, joined by blank lines."""
    rows = reviews.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(position))).where(F.col("__n") <= limit)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.substring(F.col(body), 1, width).alias("b")))), lambda x: x["b"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n\n").alias("digest"))


def review_prompts(reviews: DataFrame, key: str, position: str, body: str, size: int = 10, width: int = 1500) -> DataFrame:
    """key, batch (from 0) and text: the reviews' bodies, `size` in a batch, cut to the width that a prompt has room for, joined by blank lines."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1
    rows = reviews.select(key, F.floor(n / size).cast("long").alias("batch"), n.alias("__n"), F.substring(F.coalesce(body, F.lit("")), 1, width).alias("__b"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("__n", "__b"))), lambda x: x["__b"])
    return rows.groupBy(key, "batch").agg(F.array_join(texts, "\n\n").alias("text"))
