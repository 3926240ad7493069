"""Structure recovery over DataFrames: the sequential parts run in Arrow batches, a whole description or show at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions.alignment import align
from stagewise.functions.setlist import Song, date_forms, drop_artist, parse_setlist, place_forms, strip_banner
from stagewise.functions.text import same_place
from stagewise.functions.titles import SHORTHAND
from stagewise.shipping import ship

SONG = pa.struct([("title", pa.string()), ("normalized", pa.string()), ("set", pa.string()), ("segue", pa.bool_())])
SONGS = "array<struct<title:string,normalized:string,set:string,segue:boolean>>"


def parse_setlists(df: DataFrame, key: str, text: str, artist: str | None = None, places: list[str] | None = None, date: str | None = None) -> DataFrame:
    """key, items and confidence of each description; with artist, places and date columns the show's banner is stripped. A null text has no items."""
    ship(df.sparkSession)
    extra = [F.col(artist) if artist else F.lit(None).cast("string"), F.concat_ws(",", *(places or [])), F.col(date).cast("string") if date else F.lit(None).cast("string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, trust = [], []
            for said, who, where, when in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                songs, confidence = parse_setlist(said)
                if who or where or when:
                    songs, confidence = strip_banner(songs, confidence, place_forms(who) | place_forms(where) | date_forms(when))
                    songs = drop_artist(songs, who or "")
                items.append([{"title": s.title, "normalized": s.normalized, "set": s.set, "segue": s.segue} for s in songs])
                trust.append(confidence)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(SONG)), pa.array(trust, pa.string())], names=[key, "items", "confidence"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("__text"), *[c.alias(f"__x{k}") for k, c in enumerate(extra)]).mapInArrow(run, f"`{key}` {kind}, items {SONGS}, confidence string")


def without_banners(df: DataFrame, key: str, artist: str, places: list[str], date: str) -> DataFrame:
    """key, items and confidence of parsed setlists, without the show's own banner above the songs and without its artist's name."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, trust = [], []
            for listed, confidence, who, where, when in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                songs = [Song(x["title"], x["set"], x["segue"]) for x in listed or []]
                songs, confidence = strip_banner(songs, confidence, place_forms(who) | place_forms(where) | date_forms(when))
                songs = drop_artist(songs, who or "")
                items.append([{"title": s.title, "normalized": s.normalized, "set": s.set, "segue": s.segue} for s in songs])
                trust.append(confidence)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(SONG)), pa.array(trust, pa.string())], names=[key, "items", "confidence"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "items", "confidence", artist, F.concat_ws(",", *places).alias("__places"), F.col(date).cast("string").alias("__date")).mapInArrow(run, f"`{key}` {kind}, items {SONGS}, confidence string")


def align_tracks(tracks: DataFrame, items: DataFrame, show: str, index: str, title: str, position: str, item_title: str, label: str, segue: str, lookahead: int = 8, family: bool | str = False) -> DataFrame:
    """show, track index, set_label, segue, matched, and the show's coverage, conflicts and merge_conflicts. Shows without items get unmatched tracks in set 1.

    family: whether the family's short names of songs apply, for all shows or by a column of tracks.
    """
    ship(tracks.sparkSession)
    short = F.first(F.col(family)) if isinstance(family, str) else F.first(F.lit(family))
    a = tracks.groupBy(show).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("long").alias("i"), F.coalesce(title, F.lit("")).alias("t")))).alias("tracks"), short.alias("__family"))
    b = items.groupBy(F.col(show).alias("__s")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.coalesce(item_title, F.lit("")).alias("t"), F.col(label).alias("s"), F.col(segue).alias("g")))).alias("items"))
    rows = a.join(b, F.col(show) == F.col("__s"), "left").select(show, "tracks", "items", "__family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [show, index, "set_label", "segue", "matched", "coverage", "conflicts", "merge_conflicts"]
        kinds = [None, pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        for batch in batches:
            out = []
            for key, own, listed, among in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = align([x["t"] for x in own], [(x["t"], x["s"], x["g"]) for x in listed or []], lookahead, SHORTHAND if among else None)
                merged = [own[k - 1]["i"] for k in got.merge_conflicts]
                out += [(key, x["i"], s, g, m, got.coverage, got.conflicts, merged) for x, s, g, m in zip(own, got.sets, got.segues, got.matched, strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.schema.field(0).type) for c, k in zip(cols, kinds, strict=True)], names=names)

    kind = tracks.schema[show].dataType.simpleString()
    return rows.mapInArrow(run, f"`{show}` {kind}, `{index}` long, set_label string, segue boolean, matched boolean, coverage double, conflicts array<string>, merge_conflicts array<long>")


def venue_mismatches(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key with equivalent: whether the two venue names may be one place."""
    return df.select(key, same_place(a, b).alias("equivalent"))
