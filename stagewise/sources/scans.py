"""File scans with explicit schemas. Bad rows never abort: they become nulls or a state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.functions.text import try_int

LEDGER = "performance_id string, artist string, date string, venue string, status string, run string, recorded_at string"
EVIDENCE = "date string, artist string, event_id string, venue string, city string, state string, show_set string, time string, song string, song_n string, isong string, next_set string, Nevents string, ievent string, break_length string"
PROBE = "format struct<duration:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,duration:string,tags:map<string,string>>>"
MANIFEST = "schema_version int, briefing struct<file:string,json:string,narration:string,vetted:boolean>, show map<string,string>, source map<string,string>, tracks array<struct<index:int,`set`:string,title:string,filename:string>>, set_breaks array<struct<after_track:int>>, dj_notes string, dj_audio string, total_duration_sec double, set_durations_sec map<string,double>, _corrupt string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ledger of JSON lines, with pos, their order within a file; blank lines are skipped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", LEDGER).alias("r"), "pos").select("r.*", "pos")


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence rows with integers that may be null."""
    rows = spark.read.csv(path, header=True, schema=EVIDENCE)
    return rows.withColumns({"isong": try_int("isong"), "ievent": F.coalesce(try_int("ievent"), F.lit(1))})


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def playlists(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, entry, title, problem) of m3u files: an EXTINF title binds to the next entry; addresses and empty lists are problems."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    title = F.when(F.col("line").startswith("#EXTINF"), F.regexp_extract("line", r"^#EXTINF:[^,]*,(.*)$", 1))
    entry = ~F.col("line").startswith("#")
    # titles since the entry before: the last one binds
    lines = lines.withColumn("__entries", F.sum(entry.cast("int")).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("title", F.last(title, ignorenulls=True).over(Window.partitionBy("file", F.coalesce("__entries", F.lit(0))).orderBy("n")))
    found = lines.where(entry).select("file", F.row_number().over(Window.partitionBy("file").orderBy("n")).alias("pos"), F.col("line").alias("entry"), "title", F.when(F.col("line").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), "address").alias("problem"))
    empty = files.join(found.select(F.col("file").alias("__f")).distinct(), F.col("file") == F.col("__f"), "left_anti")
    return found.unionByName(empty.select("file", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("title"), F.lit("empty").alias("problem")))


def probes(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key with codec, rate, channels, seconds, title and artist of media probes in JSON; tags of the audio stream beat those of the file."""
    p = df.select(key, F.from_json(raw, PROBE).alias("p"))
    p = p.withColumn("s", F.get(F.filter("p.streams", lambda s: s["codec_type"] == "audio"), F.lit(0)))
    tag = lambda name: F.coalesce(F.try_element_at("s.tags", F.lit(name)), F.try_element_at("p.format.tags", F.lit(name)))
    return p.select(key, F.col("s.codec_name").alias("codec"), try_int("s.sample_rate").alias("sample_rate"), F.col("s.channels").alias("channels"), F.coalesce(F.col("p.format.duration").try_cast("double"), F.col("s.duration").try_cast("double")).alias("seconds"), tag("title").alias("title"), tag("artist").alias("artist"))


def lexicon(*layers: DataFrame) -> DataFrame:
    """(written, spoken) of several layers; later ones override earlier ones; rows without both are skipped."""
    out = None
    for k, layer in enumerate(layers):
        rows = layer.select(F.trim("written").alias("written"), F.trim("spoken").alias("spoken"), F.lit(k).alias("layer")).where("written <> '' and spoken <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("written").agg(F.max_by("spoken", "layer").alias("spoken"))


def packages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each manifest under path/*/, with state: pending, ready (voiced), unsupported (an old schema) or error (no JSON)."""
    raw = spark.read.text(f"{path}/*/manifest.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = raw.select("path", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m")).select("path", "m.*")
    bad = F.col("_corrupt").isNotNull() | F.col("schema_version").isNull()
    state = F.when(bad, "error").when(F.col("schema_version") < 3, "unsupported").when(F.col("dj_notes").isNotNull() & F.col("dj_audio").isNotNull(), "ready").otherwise("pending")
    return rows.withColumn("state", state).drop("_corrupt")


def missing_from_cache(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys of wanted that the cache lacks: what a read-through fetch has to get."""
    return wanted.select(key).distinct().join(cache.select(F.col(key).alias("__c")), F.col(key) == F.col("__c"), "left_anti")


def pick_setlist(found: DataFrame, show: str, venue: str, city: str, result_venue: str, result_city: str, position: str) -> DataFrame:
    """The setlist of each show: the first whose venue contains, or is contained in, the show's; without a venue, the only one; else by city."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", "")
    meets = lambda a, b: (flat(a) != "") & (flat(b) != "") & (flat(a).contains(flat(b)) | flat(b).contains(flat(a)))
    n = F.count(F.lit(1)).over(Window.partitionBy(show))
    tier = F.when(meets(venue, result_venue), 1).when((flat(venue) == "") & (n == 1), 2).when(meets(city, result_city), 3)
    ranked = found.withColumn("__t", tier).where("__t is not null").withColumn("__n", F.row_number().over(Window.partitionBy(show).orderBy("__t", position)))
    return ranked.where("__n = 1").drop("__t", "__n")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """run, updated_at, state and body of the sessions under path/*/session.json, the newest first: incomplete if the file is no JSON or names no state."""
    raw = spark.read.text(f"{path}/*/session.json", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/session\.json$", 1).alias("run"), F.col("_metadata.file_modification_time").alias("updated_at"), "value")
    body = F.from_json("value", "state string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.withColumn("b", body)
    state = F.when(F.col("b._corrupt").isNotNull() | F.col("b.state").isNull(), "incomplete").otherwise(F.col("b.state"))
    return rows.select("run", "updated_at", state.alias("state"), F.col("value").alias("body")).orderBy(F.col("updated_at").desc(), "run")


def shelves(spark: SparkSession, path: str) -> DataFrame:
    """slug, artist, date and what there is of each show under path/*/: artist and date from show.json, else from its provenance."""
    at = lambda name, schema: spark.read.text(f"{path}/*/*.json", wholetext=True).where(F.col("_metadata.file_path").endswith(f"/{name}.json")).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("slug"), F.from_json("value", schema).alias(name))
    there = spark.read.text(f"{path}/*/*.json", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("slug"), F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("part"))
    parts = there.groupBy("slug").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    rows = parts.join(at("show", "artist string, date string"), "slug", "left").join(at("provenance", "run string, candidate struct<collection:string,date:string>"), "slug", "left")
    return rows.select("slug", F.coalesce("show.artist", "provenance.candidate.collection").alias("artist"), F.coalesce("show.date", "provenance.candidate.date").alias("date"), F.col("provenance.run").alias("run"), "parts")
