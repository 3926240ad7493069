"""A setlist service: asked for one artist and date at a time, by filters that reach the request or for all shows of a table.

The transport is a function (artist, date, **options) -> the answer, or None where the service knows nothing (its 404), named by its
import path. An answer is {"setlist": [{"venue": {"name": ..., "city": {"name": ...}}, ...}, ...]}. Failures never end a query: they
are rows with an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from stagewise.sources.remote import called, fetch, read_through
from stagewise.sources.scans import pick_setlist

ANSWER = "struct<setlist:array<struct<venue:struct<name:string,city:struct<name:string>>>>>"


def plain(name: str) -> str:
    """An artist's name in lower case, without signs: what is asked for where the full name finds nothing."""
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower().replace("'", "")).split())


def found(call, artist: str, date: str, fetch_options: dict, options: dict) -> list[dict]:
    """The setlists of an artist and date; without any, those of the artist's plain name."""
    for name in dict.fromkeys([artist, plain(artist)]):
        if name and (name == artist or name != artist.lower()):
            answer = fetch(lambda n=name: call(n, date, **options), **fetch_options)
            if answer and answer.get("setlist"):
                return answer["setlist"]
    return []


class Asked(InputPartition):
    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = pairs


#: Options of the source itself; others go to the transport.
OWN = ("transport", "tries", "wait", "pause", "readers", "path")


class SetlistReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.transport = options["transport"]
        self.readers = int(options.get("readers", 4))
        self.fetching = {"tries": int(options.get("tries", 3)), "wait": float(options.get("wait", 1)), "pause": float(options.get("pause", 1)) * self.readers}
        self.options = {k: v for k, v in options.items() if k not in OWN}
        self.asked: dict[str, list[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in ("artist", "date"):
                yield f  # Spark's to test
                continue
            these = [x for x in ([f.value] if isinstance(f, EqualTo) else f.value) if x is not None]
            both = [x for x in self.asked.get(column, these) if x in these]
            self.asked[column] = list(dict.fromkeys(both))

    def partitions(self) -> list[InputPartition]:
        if not {"artist", "date"} <= set(self.asked):
            raise ValueError("setlists are asked for by artist and date: filter both by = or IN")
        pairs = [(a, d) for a in self.asked["artist"] for d in self.asked["date"]]
        return [Asked(pairs[k :: self.readers]) for k in range(min(self.readers, len(pairs)))]

    def read(self, partition: Asked) -> Iterator[tuple]:
        call = called(self.transport)
        for artist, date in partition.pairs:
            try:
                for k, one in enumerate(found(call, artist, date, self.fetching, self.options), 1):
                    venue = one.get("venue") or {}
                    yield (artist, date, k, venue.get("name"), (venue.get("city") or {}).get("name"), json.dumps(one), None)
            except Exception as e:
                yield (artist, date, None, None, None, None, f"{type(e).__name__}: {e}"[:500])


class SetlistSource(DataSource):
    """spark.read.format("setlists").options(transport=...).load().where("artist = 'A' and date in ('1977-05-08', '1977-05-09')")

    Needs spark.sql.python.filterPushdown.enabled. Every pair of a filtered artist and date is one request (two if the first finds
    nothing); for the pairs of a table take `setlists_of`.
    """

    @classmethod
    def name(cls) -> str:
        return "setlists"

    def schema(self) -> str:
        return "artist string, date string, pos int, venue string, city string, record string, error string"

    def reader(self, schema) -> DataSourceReader:
        return SetlistReader(self.options)


def setlists_of(shows: DataFrame, cache_path: str, transport: str, tries: int = 3, wait: float = 1.0, pause: float = 1.0, readers: int = 4, **options) -> DataFrame:
    """shows (show, artist, date, venue, city) with found_venue, found_city, record and error of the service's setlist that fits venue or city.

    Each artist and date is asked for once, whatever the number of shows, and kept at the cache's path, empty answers too; failures are
    asked for again by the next call. Shows without an artist or date, or without a fitting setlist, have nulls.
    """
    fetching = {"tries": tries, "wait": wait, "pause": pause * readers}

    def ask(key: str) -> dict:
        return {"setlist": found(called(transport), *json.loads(key), fetching, options)}

    keyed = shows.withColumn("__key", F.when(F.col("artist").isNotNull() & F.col("date").isNotNull(), F.to_json(F.array("artist", "date"))))
    answers = read_through(keyed.select("__key"), cache_path, "__key", ask, tries=1, wait=0, pause=0, readers=readers)
    # records stay whole: the answer's entries are read once for their names and once as they are
    names = F.from_json("record", ANSWER)["setlist"]
    whole = F.from_json("record", "struct<setlist:array<string>>")["setlist"]
    entries = answers.where("error is null").select("__key", F.posexplode(F.arrays_zip(names.alias("names"), whole.alias("whole"))).alias("pos", "e"))
    entries = entries.select("__key", "pos", F.col("e.names.venue.name").alias("found_venue"), F.col("e.names.venue.city.name").alias("found_city"), F.col("e.whole").alias("record"))
    picked = pick_setlist(keyed.select("show", "venue", "city", "__key").join(entries, "__key"), "show", "venue", "city", "found_venue", "found_city", "pos")
    errors = answers.where("error is not null").select("__key", "error")
    return keyed.join(picked.select("show", "found_venue", "found_city", "record"), "show", "left").join(errors, "__key", "left").drop("__key")
