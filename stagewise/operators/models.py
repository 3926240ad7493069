"""Model tasks with typed answers: several keys in a prompt, answers checked against a type and joined back by key.

A task's answer is a list of rows of one type (a struct, with arrays in it). The prompt holds a batch of keys; rows that
fit are taken, and keys that the answer misses or answers wrongly are asked alone, with the reason. What is asked is
neither shuffled nor collected: batches are formed from a partition's rows as they come. Answers cost money: tasks that
use them more than once write them out first, and callers of run_batched() do so (shipping.checkpointed, stages.Kept).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.text import normalize_date, normalize_title
from stagewise.functions.titles import ALIASES
from stagewise.operators import guards, structure
from stagewise.operators.tasks import WAITS, ask, extract_json, render
from stagewise.shipping import checkpointed, ship

#: What the tasks answer, but for the key.
ASSESSMENT = "quality_score double not null, non_attendee_evidence string, recording_complaints array<string>, rationale string"
SETLIST = "items array<struct<title:string not null,set:string not null,segue:boolean>> not null, confidence string"
STRUCTURE = "tracks array<struct<index:int not null,set:string not null,segue:boolean,matched_title:string>> not null"
VETTING = "asserted_songs array<string> not null, asserted_dates array<string>, asserted_set_count int"

_WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def fitted(value: object, kind: T.DataType, at: str = "answer"):
    """The value as the type holds it. ValueError names the place that doesn't fit; fields that the type lacks are left out, absent ones are null."""
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise ValueError(f"{at} is no object")
        out = {}
        for f in kind.fields:
            if value.get(f.name) is None:
                if not f.nullable:
                    raise ValueError(f"{at}.{f.name} is missing")
                out[f.name] = None
            else:
                out[f.name] = fitted(value[f.name], f.dataType, f"{at}.{f.name}")
        return out
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"{at} is no list")
        return [fitted(x, kind.elementType, f"{at}[{k}]") for k, x in enumerate(value)]
    if isinstance(kind, T.BooleanType):
        fits = isinstance(value, bool)
    elif bits := _WHOLE.get(type(kind)):
        fits = isinstance(value, int) and not isinstance(value, bool) and -(2 ** (bits - 1)) <= value < 2 ** (bits - 1)
    elif isinstance(kind, T.DoubleType):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) <= 1.7e308 and math.isfinite(value)
        value = float(value) if fits else value
    elif isinstance(kind, T.StringType):
        fits = isinstance(value, str)
    else:
        raise TypeError(f"{kind.simpleString()} isn't a type of answers")
    if not fits:
        raise ValueError(f"{at} is no {kind.simpleString()}")
    return value


def _answered(answer: object, name: str, key: str, kind: T.StructType) -> tuple[dict[str, dict], dict[str, str]]:
    """(rows that fit, why others don't) by key; of a key that is answered twice, the first row that fits counts."""
    if not isinstance(answer, dict) or not isinstance(answer.get(name), list):
        raise ValueError(f"{name} is no list")
    good: dict[str, dict] = {}
    bad: dict[str, str] = {}
    for row in answer[name]:
        said = row.get(key) if isinstance(row, dict) else None
        if isinstance(said, (str, int)) and not isinstance(said, bool):
            try:
                good.setdefault(str(said), fitted(row, kind))
            except ValueError as e:
                bad.setdefault(str(said), str(e))
    return good, bad


def asked(provider: Callable | Sequence[Callable], template: str, name: str, key: str, kind: T.StructType, items: Sequence[dict], tries: int = 3, waits: Sequence[float] = WAITS) -> list[tuple[dict | None, str | None]]:
    """(answer, error) of each item of one prompt, in order. Rows of keys that weren't asked are left out.

    Items that the answer leaves open, or whose key stands among the items before, are asked alone. A call that fails for
    other reasons than its answer (it broke off, or is refused) is the error of all its items.
    """
    prompt = lambda some: render(template, items=json.dumps(some, ensure_ascii=False, default=str))
    out: list[tuple[dict | None, str | None]] = [(None, "not asked")] * len(items)
    first = {item[key]: k for k, item in reversed(list(enumerate(items)))}
    alone = [k for k, item in enumerate(items) if first[item[key]] != k]
    reasons: dict[str, str] = {}
    if len(first) > 1:
        try:
            said = ask(provider, prompt([items[k] for k in sorted(first.values())]), lambda x: _answered(x, name, key, kind), extract_json, tries, waits)
            good, reasons = _answered(said, name, key, kind)
        except ValueError:
            good = {}
        except Exception as e:
            for k in first.values():
                out[k] = (None, f"{type(e).__name__}: {e}"[:500])
            good, first = {}, {}
        for said_key, k in first.items():
            if said_key in good:
                out[k] = (good[said_key], None)
            else:
                alone.append(k)
    else:
        alone += first.values()

    for k in sorted(alone):
        mine = items[k][key]

        taken: dict[str, dict] = {}

        def check(x: object, mine: str = mine, taken: dict = taken) -> None:
            good, bad = _answered(x, name, key, kind)
            if mine not in good:
                raise ValueError(bad.get(mine, f"{mine} has no row"))
            taken[mine] = good[mine]

        note = f"\n\nAn answer before this one was not valid: {reasons[mine]}" if mine in reasons else ""
        try:
            ask(provider, prompt([items[k]]) + note, check, extract_json, tries, waits)
            out[k] = (taken[mine], None)
        except Exception as e:
            out[k] = (None, f"{type(e).__name__}: {e}"[:500])
    return out


def run_batched(df: DataFrame, key: str, inputs: Sequence[str], template: str, provider: Callable | Sequence[Callable], name: str, fields: str, size: int = 5, tries: int = 3, waits: Sequence[float] = WAITS) -> DataFrame:
    """key, answer (a struct of the fields), error: a row for each row of df; where a row fails, no answer and the reason.

    The template's {{items}} are the batch's keys and inputs as JSON; the answer is an object whose list `name` holds a row a
    key, which names it. Keys are compared as text. A row whose key is null isn't asked.
    """
    ship(df.sparkSession)
    kind = T.StructType.fromDDL(fields)
    if key in kind.fieldNames():
        raise ValueError(f"{key} names the key and can't be a field of the answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            answers: list[tuple[dict | None, str | None]] = [(None, "no key")] * len(rows)
            open_rows = [k for k, row in enumerate(rows) if row["__key"] is not None]
            for at in range(0, len(open_rows), size):
                mine = open_rows[at : at + size]
                items = [{key: rows[k]["__key"]} | {n: rows[k][f"__in{i}"] for i, n in enumerate(inputs)} for k in mine]
                for k, got in zip(mine, asked(provider, template, name, key, kind, items, tries, waits), strict=True):
                    answers[k] = got
            said = pa.array([None if a is None else json.dumps(a) for a, _ in answers], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), said, pa.array([e for _, e in answers], pa.string())], names=["__own", "__said", "error"])

    own = df.schema[key].dataType.simpleString()
    sent = df.select(F.col(key).alias("__own"), F.col(key).cast("string").alias("__key"), *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)])
    got = sent.mapInArrow(run, f"__own {own}, __said string, error string")
    return got.select(F.col("__own").alias(key), F.from_json("__said", kind).alias("answer"), "error")


def score_reviews(candidates: DataFrame, key: str, inputs: Sequence[str], template: str, provider, reviewed: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(assessments by key, failures with error). reviewed: the column with the recording whose reviews were sent; the model doesn't say it."""
    got = checkpointed(run_batched(candidates, key, inputs, template, provider, "assessments", ASSESSMENT, **options))
    good = got.where("answer is not null").select(key, "answer.*").withColumn("recording_complaints", F.coalesce("recording_complaints", F.array().cast("array<string>")))
    if reviewed:
        about = candidates.dropDuplicates([key]).select(F.col(key).alias("__k"), F.col(reviewed).alias("reviewed_identifier"))
        good = good.join(about, F.col(key) == F.col("__k")).drop("__k")
    return good, got.where("answer is null").select(key, "error")


def complaints(recordings: DataFrame, assessments: DataFrame, key: str, item: str) -> DataFrame:
    """recordings with complaints: how many an assessment of the performance has, for the one recording that was reviewed; 0 for all others."""
    said = assessments.groupBy(F.col(key).alias("__k"), F.col("reviewed_identifier").alias("__i")).agg(F.max(F.size("recording_complaints")).alias("__n"))
    rows = recordings.join(said, (F.col(key) == F.col("__k")) & (F.col(item) == F.col("__i")), "left")
    return rows.withColumn("complaints", F.greatest(F.coalesce("__n", F.lit(0)), F.lit(0))).drop("__k", "__i", "__n")


def extract_setlists(descriptions: DataFrame, key: str, text: str, template: str, provider, **options) -> tuple[DataFrame, DataFrame]:
    """(key, items, confidence) of descriptions, as parse_setlists gives them, and failures; an unknown confidence is low, one prompt holds one description."""
    got = run_batched(descriptions, key, [text], template, provider, "setlists", SETLIST, **({"size": 1} | options))
    song = lambda x: F.struct(x["title"].alias("title"), normalize_title(x["title"], ALIASES).alias("normalized"), x["set"].alias("set"), F.coalesce(x["segue"], F.lit(False)).alias("segue"))
    trust = F.when(F.col("answer.confidence").isin("low", "medium", "high"), F.col("answer.confidence")).otherwise("low")
    # a row has an answer or an error; asked of the answer, its JSON would be read twice
    good = got.where("error is null").select(key, F.transform("answer.items", song).alias("items"), trust.alias("confidence"))
    return good, got.where("error is not null").select(key, "error")


def align_structures(tracks: DataFrame, items: DataFrame, show: str, index: str, title: str, position: str, item_title: str, label: str, template: str, provider, **options) -> tuple[DataFrame, DataFrame]:
    """(tracks as applied_alignment gives them, failures): a model says each track's set; only answers that name each track once, with known sets, are taken."""
    own = tracks.groupBy(show).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("index"), F.col(title).alias("title")))).alias("tracks"))
    listed = items.groupBy(F.col(show).alias("__s")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), F.col(item_title).alias("title"), F.col(label).alias("set")))).alias("setlist"))
    rows = own.join(listed, F.col(show) == F.col("__s"), "left").select(show, "tracks", "setlist")
    got = checkpointed(run_batched(rows, show, ["tracks", "setlist"], template, provider, "shows", STRUCTURE, **({"size": 1} | options)))
    said = got.where("answer is not null").select(show, F.explode("answer.tracks").alias("t")).select(show, F.col("t.index").alias("index"), F.col("t.set").alias("set"), F.col("t.segue").alias("segue"), F.col("t.matched_title").alias("matched_title"))
    if index != "index":
        said = said.withColumnRenamed("index", index)
    return structure.applied_alignment(tracks, said, show, index, title, "set", "segue", "matched_title"), got.where("answer is null").select(show, "error")


def vet_research(research: DataFrame, facts: DataFrame, dates: DataFrame, show: str, text: str, known: str, date: str, template: str, provider, **options) -> tuple[DataFrame, DataFrame]:
    """(show, asserted, unknown, names, flagged, wrong_dates, adopted, set_count; failures) of what a model reads out of each show's research.

    facts: show, known (a title); dates: show, date. adopted: the date that replaces a placeholder; wrong_dates: those asserted that differ from the show's.
    """
    got = checkpointed(run_batched(research, show, [text], template, provider, "shows", VETTING, **({"size": 1} | options)))
    good = got.where("answer is not null").select(show, "answer.*")
    songs = guards.grounding_flags(good.select(show, F.explode("asserted_songs").alias("song")), facts, show, "song", known)
    when = F.array_compact(F.transform(F.coalesce("asserted_dates", F.array().cast("array<string>")), normalize_date))
    about = good.select(F.col(show).alias("__s"), when.alias("__dates"), F.col("asserted_set_count").alias("set_count")).join(dates.select(F.col(show).alias("__d"), F.col(date).alias("__date")), F.col("__s") == F.col("__d"), "left")
    adopted = guards.adopted_date(F.col("__dates"), F.col("__date"))
    about = about.select("__s", guards.dates_disagree(F.col("__dates"), F.coalesce(adopted, F.col("__date"))).alias("wrong_dates"), adopted.alias("adopted"), "set_count")
    out = about.join(songs, F.col("__s") == F.col(show), "left").withColumn(show, F.col("__s")).drop("__s")
    empty = F.array().cast("array<string>")
    return out.withColumns({"asserted": F.coalesce("asserted", F.lit(0)), "unknown": F.coalesce("unknown", F.lit(0)), "names": F.coalesce("names", empty), "flagged": F.coalesce("flagged", F.lit(False))}), got.where("answer is null").select(show, "error")
