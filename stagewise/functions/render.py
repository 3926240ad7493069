"""Text for people and players: lists, tables, metadata files, spoken sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.text import format_count

#: Words whose full stop ends no sentence.
SHORTENED = ["mr.", "mrs.", "ms.", "dr.", "st.", "vs.", "jr.", "sr.", "mt.", "ft.", "etc.", "inc.", "co.", "ave."]
SHORTEST_SENTENCE = 20


def lines_of(df: DataFrame, keys: list[str], order: list[str], line: Column, name: str = "text") -> DataFrame:
    """keys with the lines of their rows, in order."""
    rows = df.select(*keys, F.struct(*[F.col(o) for o in order], line.alias("__line")).alias("r"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["__line"]), "\n").alias(name))


def track_line(index: Column, filename: Column, title: Column, seconds: Column) -> Column:
    return F.concat_ws(" | ", index.cast("string"), filename, title, F.coalesce(seconds.cast("string"), F.lit("?")))


def setlist_line(label: Column, title: Column, segue: Column) -> Column:
    return F.concat(F.lit("[set "), label, F.lit("] "), title, F.when(segue, " >").otherwise(""))


def artist_line(identifier: Column, title: Column, recordings: Column, first: Column, last: Column, downloads: Column) -> Column:
    years = F.coalesce(F.concat(first.cast("string"), F.lit("-"), last.cast("string")), F.lit("?"))
    return F.concat_ws(" | ", identifier, title, F.concat(recordings.cast("string"), F.lit(" recordings")), years, F.concat(format_count(downloads), F.lit(" downloads")))


def age(then: Column, now: Column) -> Column:
    """3h, 2d: the largest whole unit of the time since, never negative."""
    s = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then)).cast("long")
    unit = lambda n, letter: F.concat(F.floor(s / n).cast("string"), F.lit(letter))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


def ranks(text: Column) -> Column:
    """The numbers among tokens divided by commas; others are ignored."""
    tokens = F.transform(F.split(text, ","), F.trim)
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike(r"^\d+$")), lambda t: t.cast("int")))


def discovery_query(query: Column, start: Column, end: Column) -> Column:
    """The request as it was said, and its era if it has a bound."""
    era = F.when(start.isNotNull() | end.isNotNull(), F.concat(F.lit("Era: "), F.coalesce(start, F.lit("any")), F.lit(" to "), F.coalesce(end, F.lit("any"))))
    return F.concat_ws("\n", query, era)


def vetting_text(flags: Column, adopted: Column, context: Column) -> Column:
    first = F.when(F.size(flags) > 0, F.concat(F.lit("Flags: "), F.array_join(flags, "; "))).otherwise("No flags.")
    return F.concat_ws("\n", first, F.concat(F.lit("Date corrected to "), adopted), F.nullif(F.concat(F.lit("Context: "), context), F.lit("Context: ")))


def refusal_hint(reasons: Column) -> Column:
    return F.when(F.array_contains(reasons, "held for review"), "resolve the hold").when(F.size(reasons) > 0, "package again")


def escaped_metadata(value: Column) -> Column:
    r"""=, ;, #, \ and line ends behind a backslash."""
    return F.regexp_replace(value, r"([=;#\\\n])", r"\\$1")


def chapters(df: DataFrame, show: str, index: str, title: str, start_ms: str, end_ms: str) -> DataFrame:
    """(show, text): a metadata file with a chapter for each track."""
    one = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col(start_ms).cast("string"), F.lit("\nEND="), F.col(end_ms).cast("string"), F.lit("\ntitle="), escaped_metadata(F.col(title)))
    return lines_of(df, [show], [index], one).select(show, F.concat(F.lit(";FFMETADATA1\n"), F.col("text"), F.lit("\n")).alias("text"))


def concat_list(df: DataFrame, show: str, index: str, path: str) -> DataFrame:
    r"""(show, text): file 'path' lines; a quote is closed, escaped and opened again."""
    quoted = F.concat(F.lit("file '"), F.replace(F.col(path), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return lines_of(df, [show], [index], quoted).select(show, F.concat(F.col("text"), F.lit("\n")).alias("text"))


def sentences(text: str) -> list[str]:
    """Sentences; those that end in a shortened word, an initial or a number before a number, and short ones, are joined with their neighbour."""
    out: list[str] = []
    for part in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", text.strip()))):
        if out:
            last = out[-1].split()[-1].lower()
            goes_on = last in SHORTENED or re.fullmatch(r"[^\W\d_]\.", last) or (last[:-1].isdigit() and part[0].isdigit())
            if goes_on or min(len(out[-1]), len(part)) < SHORTEST_SENTENCE:
                out[-1] += f" {part}"
                continue
        out.append(part)
    return out or [text.strip()]


def with_neighbours(df: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """df with previous_text and next_text."""
    by = Window.partitionBy(key).orderBy(position)
    return df.withColumns({"previous_text": F.lag(text).over(by), "next_text": F.lead(text).over(by)})


def speech_key(*columns: Column) -> Column:
    """The key of a spoken clip: what it says and how; equal keys needn't be spoken again."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def bitrate(rate: Column) -> Column:
    """kbit/s for mono speech at a sample rate."""
    return F.when(rate <= 24_000, 64).when(rate <= 32_000, 96).otherwise(128)


def wrapped(text: Column, width: int = 90, most: int | None = 3) -> Column:
    """Lines of at most `width` characters of the text with its blanks squeezed, broken at blanks (a longer word is cut); beyond `most` lines the last one ends in an ellipsis."""
    said = F.trim(F.regexp_replace(text, r"\s+", " "))
    lines = F.regexp_extract_all(said, F.lit(rf"(\S.{{0,{width - 1}}}(?=\s|$)|\S{{{width}}})\s*"), F.lit(1))
    lines = F.transform(lines, lambda x: F.rtrim(x))
    if most is None:
        return lines
    cut = F.slice(lines, 1, most)
    return F.when(F.size(lines) > most, F.concat(F.slice(cut, 1, most - 1), F.array(F.concat(F.element_at(cut, most), F.lit(" …"))))).otherwise(lines)
