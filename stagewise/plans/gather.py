"""From files, descriptions and evidence to shows: all shows at once, in four steps that are written out.

files: show, name, source, original, format, length, track, title, pos. descriptions: show, pos, text (the chosen
recording's first). shows: show, artist, venue, city, date, family (whether the family's short names apply). closers
(evidence of set ends): show, k, name, closer, place. service: show, sets (of a setlist service). siblings: show, item,
pos, index, title: tracks of other recordings. overrides: show, exclude, titles, set_breaks, encore_after, venue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions import text as X
from stagewise.operators import files as files_of
from stagewise.operators import recovery, structure
from stagewise.shipping import checkpointed

COVERAGE, PREFERENCE = 0.8, ("VBR MP3", "Flac")
#: Titles come from a lossless copy where fewer than this share are real, and at least that share of the copy's are.
RECOVER_BELOW, RECOVER_ABOVE, LOSSLESS = 0.5, 0.9, ("Flac", "24bit Flac", "Shorten")
OVERRIDES = "show string, exclude array<string>, titles map<int,string>, set_breaks array<int>, encore_after int, venue string"


def numbered_titles(files: DataFrame, preference: Sequence[str]) -> DataFrame:
    """files with tag, a cleaned title, of each show's preferred format, without junk, in play order (position)."""
    numbers = files_of.track_numbers(files, "show", name="name", source="source", original="original", track="track")
    originals = files.where("source = 'original'").select(F.col("show").alias("__s"), F.col("name").alias("__o")).distinct()
    rows = numbers.where(F.col("format").isin(list(preference))).withColumns({"item": F.concat_ws("\x1f", "show", "format"), "stem": X.name_stem("name"), "seconds": X.length_seconds("length")})
    # derivatives refer to originals in other formats: those count as files of the item
    rows = rows.join(originals, (F.col("show") == F.col("__s")) & (F.col("original") == F.col("__o")), "left")
    rows = rows.withColumn("source", F.when((F.col("source") == "derivative") & F.col("__o").isNotNull(), "original").otherwise(F.col("source"))).drop("__s", "__o")
    judged = files_of.junk_filter(rows, "item", name="name", stem="stem", source="source", original="original", seconds="seconds", position="pos")
    best = files_of.format_preference(judged, "show", "format", F.size("reasons") == 0, preference).select(F.col("show").alias("__s"), F.col("format").alias("__f"))
    kept = judged.where(F.size("reasons") == 0).join(best, (F.col("show") == F.col("__s")) & (F.col("format") == F.col("__f"))).drop("__s", "__f")
    return files_of.strip_numbering(files_of.play_order(kept, "show", "number", "name").withColumn("tag", X.clean_tag("title")), "show", "tag")


def recovered_titles(files: DataFrame, kept: DataFrame) -> DataFrame:
    """show, name, recovered: titles of the first lossless copy that has the same tracks, of shows whose own tags are missing."""
    whole = Window.partitionBy("show")
    poor = kept.withColumn("__share", F.avg(X.is_real_title("tag").cast("double")).over(whole)).where(F.col("__share") < RECOVER_BELOW)
    poor = poor.select("show", "name", F.col("format").alias("own"), X.stem_no_extension("name").alias("stem"))
    found: DataFrame | None = None
    for k, kind in enumerate(LOSSLESS):
        other = numbered_titles(files, [kind]).select("show", X.stem_no_extension("name").alias("stem"), F.col("tag").alias("recovered"))
        mine = poor.where(F.col("own") != kind)
        same = files_of.sibling_bijection(mine, other, "show", "stem").where("matched").select("show")
        pairs = mine.join(same, "show", "left_semi").join(other, ["show", "stem"])
        pairs = pairs.withColumn("__share", F.avg(X.is_real_title("recovered").cast("double")).over(whole)).where(F.col("__share") >= RECOVER_ABOVE).select("show", "name", "recovered", F.lit(k).alias("k"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.withColumn("__first", F.min("k").over(whole)).where("k = __first").select("show", "name", "recovered")


def kept_files(files: DataFrame, overrides: DataFrame, preference: Sequence[str] = PREFERENCE) -> DataFrame:
    """show, index, name, tag, tag_source, seconds: what is left of each show's preferred format, without what an override leaves out."""
    kept = checkpointed(numbered_titles(files, preference))
    again = recovered_titles(files, kept).select(F.col("show").alias("__s"), F.col("name").alias("__n"), "recovered")
    rows = kept.join(again, (F.col("show") == F.col("__s")) & (F.col("name") == F.col("__n")), "left")
    out = overrides.select(F.col("show").alias("__t"), "exclude")
    rows = rows.join(out, F.col("show") == F.col("__t"), "left").where(~F.coalesce(F.array_contains("exclude", F.col("name")), F.lit(False)))
    # where titles were recovered, the format's own tags are known to be bad
    any_recovered = F.max(F.col("__s").isNotNull()).over(Window.partitionBy("show"))
    rows = rows.withColumns({"tag": F.when(any_recovered, F.coalesce("recovered", F.lit(""))).otherwise(F.col("tag")), "tag_source": F.when(any_recovered, "sibling-format").otherwise("tags")})
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("show").orderBy("position")).cast("long")).select("show", "index", "name", "tag", "tag_source", "seconds")


def canonical_setlists(descriptions: DataFrame, shows: DataFrame, targets: DataFrame, service: DataFrame | None = None) -> DataFrame:
    """show, items, confidence of each show's best parse, with segues of the best description if a service has it, without banner and artist."""
    parsed = recovery.parse_setlists(descriptions.select(F.to_json(F.struct("show", "pos")).alias("key"), "text"), "key", "text")
    parsed = parsed.select(F.from_json("key", "show string, pos int").alias("k"), "items", "confidence").select("k.show", F.col("k.pos").alias("pos"), "items", "confidence")
    rank = {"length": "length", "confidence": "confidence", "multi_set": F.size(F.array_distinct(F.transform("items", lambda i: i["set"]))) > 1, "target": "target", "position": "pos"}
    sized = lambda df: df.where(F.size("items") > 0).join(targets.select(F.col("show").alias("__t"), "target"), F.col("show") == F.col("__t")).drop("__t").withColumn("length", F.size("items"))
    best = structure.parse_rank(sized(parsed), "show", official=F.lit(False), **rank).select("show", "items", "confidence")
    if service is not None:
        songs = structure.from_setlist_service(service, "show", "sets").withColumns({"normalized": X.normalize_title("title", X.ALIASES), "segue": F.lit(False)})
        said = best.select("show", F.posexplode("items").alias("pos", "i")).select("show", "pos", "i.normalized", "i.segue")
        blended = structure.segue_blend(songs, said, "show", "normalized", "pos", "segue")
        item = F.struct("pos", "title", "normalized", F.col("set_label").alias("set"), F.col("blended").alias("segue"))
        official = blended.groupBy("show").agg(F.array_sort(F.collect_list(item)).alias("all"))
        official = official.select("show", F.transform("all", lambda x: F.struct(x["title"].alias("title"), x["normalized"].alias("normalized"), x["set"].alias("set"), x["segue"].alias("segue"))).alias("items"), F.lit("high").alias("confidence"))
        best = official.unionByName(best.join(official, "show", "left_anti"))
    about = shows.select(F.col("show").alias("__s"), "artist", "venue", "city", "date")
    return recovery.without_banners(best.join(about, F.col("show") == F.col("__s"), "left"), "show", "artist", ["venue", "city"], "date")


def titled(kept: DataFrame, canonical: DataFrame, siblings: DataFrame | None, overrides: DataFrame) -> DataFrame:
    """show, index, name, title, title_source, seconds: by override, tag, setlist (of as many songs), another recording's tracks, or the file's name."""
    n = kept.groupBy(F.col("show").alias("__k")).agg(F.count(F.lit(1)).alias("n_kept"))
    rows = kept.join(n, F.col("show") == F.col("__k"))
    listed = canonical.select(F.col("show").alias("__c"), "items", "confidence")
    rows = rows.join(listed, F.col("show") == F.col("__c"), "left")
    usable = (F.col("confidence") != "low") & (F.size("items") == F.col("n_kept"))
    setlist = F.when(usable, F.get("items", (F.col("index") - 1).cast("int"))["title"])
    other = F.lit(None).cast("string")
    if siblings is not None:
        lists = siblings.groupBy(F.col("show").alias("__b"), "item").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("index", "title"))).alias("t")).where(F.forall("t", lambda x: X.is_real_title(x["title"])))
        whole = lists.join(n, F.col("__b") == F.col("__k")).where(F.size("t") == F.col("n_kept")).groupBy("__b").agg(F.min_by("t", F.struct("pos", "item")).alias("__titles"))
        rows = rows.join(whole, F.col("show") == F.col("__b"), "left")
        other = F.get("__titles", (F.col("index") - 1).cast("int"))["title"]
    forced = overrides.select(F.col("show").alias("__o"), "titles")
    rows = rows.join(forced, F.col("show") == F.col("__o"), "left")
    said, tag = F.try_element_at("titles", F.col("index").cast("int")), X.is_real_title("tag")
    title = F.when(said.isNotNull(), said).when(tag, F.col("tag")).otherwise(F.coalesce(setlist, other, "name"))
    source = F.when(said.isNotNull(), "override").when(tag, F.col("tag_source")).when(setlist.isNotNull(), "setlist").when(other.isNotNull(), "sibling").otherwise("unresolved")
    return rows.select("show", "index", "name", title.alias("title"), source.alias("title_source"), "seconds")


def gather(files: DataFrame, descriptions: DataFrame, shows: DataFrame, closers: DataFrame, service: DataFrame | None = None, siblings: DataFrame | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tracks, flags): tracks with titles, sets and segues and what they rest on (alignment); what is doubtful about each show (seq, flag)."""
    spark = files.sparkSession
    overrides = overrides if overrides is not None else spark.createDataFrame([], OVERRIDES)
    kept = checkpointed(kept_files(files, overrides))
    targets = kept.groupBy("show").agg(F.count(F.lit(1)).cast("int").alias("target"))
    canonical = checkpointed(canonical_setlists(descriptions, shows, targets, service))
    tracks = titled(kept, canonical, siblings, overrides)
    items = canonical.select("show", F.posexplode("items").alias("position", "i")).select("show", "position", "i.title", "i.set", "i.segue")
    family = shows.select(F.col("show").alias("__f"), "family") if "family" in shows.columns else shows.select(F.col("show").alias("__f"), F.lit(False).alias("family"))
    tracks = tracks.join(family, F.col("show") == F.col("__f"), "left").withColumn("family", F.coalesce("family", F.lit(False))).drop("__f")
    aligned = recovery.align_tracks(tracks, items, "show", "index", "title", "position", "title", "set", "segue", family="family")
    full = tracks.drop("family").join(aligned, ["show", "index"])

    anchored = structure.anchor_breaks(full, closers, "show", "index", "title", "closer", "k", "name", "set_label").select("show", "index", "anchored")
    full = full.join(anchored, ["show", "index"], "left")
    forced = overrides.where("set_breaks is not null or encore_after is not null").select(F.col("show").alias("__o"), F.coalesce("set_breaks", F.array().cast("array<int>")).alias("__breaks"), "encore_after")
    full = full.join(forced, F.col("show") == F.col("__o"), "left")
    by_hand = F.when(F.col("index") > F.coalesce("encore_after", F.lit(2**31)), "encore").otherwise((F.size(F.filter("__breaks", lambda b: b < F.col("index"))) + 1).cast("string"))
    on_hand = F.col("__o").isNotNull()
    full = full.withColumns({"set_label": F.when(on_hand, by_hand).otherwise(F.coalesce("anchored", "set_label")), "alignment": F.when(on_hand, "override").when(F.col("anchored").isNotNull(), "evidence").otherwise("deterministic"), "coverage": F.when(on_hand, 1.0).otherwise(F.col("coverage")), "segue": F.col("segue") & ~on_hand}).drop("anchored", "__o", "__breaks", "encore_after")
    full = checkpointed(full)

    sums = full.groupBy("show").agg(F.count_distinct(F.when(F.col("set_label") != "encore", F.col("set_label"))).alias("sets"), F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"), F.first("coverage").alias("coverage"), F.first("alignment").alias("alignment"), F.first("merge_conflicts").alias("merged"), F.bool_or(F.col("title_source") == "unresolved").alias("unresolved"))
    breaks = structure.set_breaks(full, "show", "index", "set_label").groupBy("show").agg(F.count(F.lit(1)).alias("breaks"))
    known = closers.groupBy("show").agg(F.count_distinct(F.when(F.col("name") != "encore", F.col("name"))).alias("expected"))
    listed = canonical.select("show", "confidence", F.size("items").alias("n_items"), F.size(F.array_distinct(F.transform("items", lambda i: i["set"]))).alias("evidence_sets"))
    places = shows.select("show", "venue").join(overrides.select(F.col("show").alias("__o"), F.col("venue").alias("__venue")), F.col("show") == F.col("__o"), "left")
    sums = shows.select("show").join(sums, "show", "left").join(breaks, "show", "left").na.fill(0, ["breaks"]).join(known, "show", "left").join(listed, "show", "left").join(places.drop("__o"), "show", "left")
    if "place" in closers.columns:
        sums = sums.join(closers.groupBy("show").agg(F.min("place").alias("place")), "show", "left")
    else:
        sums = sums.withColumn("place", F.lit(None).cast("string"))
    plain = F.col("alignment") != "override"
    weak = (F.col("alignment") == "deterministic") & (F.col("n_items") > 0) & (F.col("coverage") < COVERAGE)
    moved = F.col("place").isNotNull() & (F.trim(F.coalesce("venue", F.lit(""))) != "") & F.col("__venue").isNull() & ~X.same_place("venue", "place")
    guard = structure.structure_guard(sums, sets="sets", breaks="breaks", seconds="seconds", expected="expected", evidence_sets="evidence_sets")
    told = [
        F.when(weak, "low-confidence structure alignment"),
        F.when(plain & (F.size("merged") > 0), F.concat(F.lit("merged tracks "), F.array_join(F.col("merged").cast("array<string>"), ", "), F.lit(" span a set break"))),
        F.when(moved, F.concat(F.lit("venue mismatch: "), "venue", F.lit(" against "), "place")),
        F.lit(None).cast("string"),
        F.when(F.col("sets").isNotNull(), guard),
        F.when(F.col("unresolved"), "unresolved track titles"),
        F.when(F.coalesce("confidence", F.lit("low")) == "low", "low-confidence setlist"),
        F.when(F.col("sets").isNull(), "no playable tracks"),
    ]
    flags = sums.select("show", F.posexplode(F.array(*told)).alias("seq", "flag")).where("flag is not null")
    loose = full.where("alignment != 'evidence'")
    verdicts = structure.closer_contradictions(loose, closers, "show", "index", "set_label", "title", "closer", "k", "name").where("verdict = 'not at a set break'")
    hard = verdicts.select("show", F.lit(3).alias("seq"), F.concat(F.lit("closer "), "closer", F.lit(" is not at a set break")).alias("flag"))
    return full, flags.unionByName(hard)
