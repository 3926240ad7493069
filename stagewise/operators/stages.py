"""Stages whose results are kept by key: versions that swap at once, resumed runs, redo of what a change touches.

A kept table is a folder of parts and a log of commits. A commit is one small file that names the parts which
count; it appears by a rename under the table's lock, so a reader sees all of a commit or none, and a reader that has
opened a version keeps it, since parts are never changed. A part holds the keys that one batch finished, each with the
fingerprint of its inputs, and their rows; of a key in several parts the latest counts.

A flow runs stages in order. A stage's fingerprint of a key is a commutative hash of all its input rows of that key and of the
stage's parameters; keys whose fingerprint isn't the kept one are computed anew, all others are not read by the stage. A stage
whose result comes out the same as before leaves the stages behind it alone.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.operators.sinks import locked
from stagewise.shipping import checkpointed

log = logging.getLogger(__name__)
#: The stages of a show and of a run, in order, and the one that a redo keeps unless asked.
RUN_STAGES, SHOW_STAGES, KEPT = ("search", "winnow"), ("select", "gather", "research", "vet", "brief", "package"), "research"


def closure(edges: DataFrame) -> DataFrame:
    """(stage, later): each stage with itself and all stages that depend on it, over edges (before, after) without cycles; a recursive query."""
    return edges.sparkSession.sql(
        "WITH RECURSIVE later_of(stage, later) AS (SELECT DISTINCT s, s FROM (SELECT before AS s FROM {e} UNION SELECT after AS s FROM {e}) UNION ALL SELECT l.stage, e.after FROM later_of l JOIN {e} e ON e.before = l.later) SELECT DISTINCT stage, later FROM later_of",
        e=edges,
    )


def touched(changed: DataFrame, edges: DataFrame, key: str, stage: str, kept: Sequence[str] = ()) -> DataFrame:
    """(key, stage) that a change of (key, stage) makes stale: that stage and all later ones, but for kept ones that didn't change themselves."""
    later = F.broadcast(closure(edges).select(F.col("stage").alias("__from"), "later"))  # a row a pair of stages
    rows = changed.join(later, F.col(stage) == F.col("__from")).where(~F.col("later").isin(*kept) | (F.col("later") == F.col(stage)))
    return rows.select(key, F.col("later").alias("stage")).distinct()


def fingerprints(key: str, inputs: Sequence[DataFrame], parameters: Mapping | None = None) -> DataFrame:
    """(key, fingerprint): of all rows of each key in all inputs, in any order of rows and columns, with map-side combining."""
    salt = F.lit(json.dumps(parameters or {}, sort_keys=True))
    hashed = []
    for place, df in enumerate(inputs):
        row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        hashed.append(df.select(key, F.sha2(F.concat(F.lit(f"{place}:"), salt, row), 256).alias("__h")))
    rows = hashed[0]
    for more in hashed[1:]:
        rows = rows.unionByName(more)
    parts = [F.conv(F.substring("__h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(2)]
    return rows.groupBy(key).agg(F.concat_ws("/", F.count(F.lit(1)), *[F.sum(x) for x in parts]).alias("fingerprint"))


def stale(now: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(key, reason) of keys to compute (new, changed) or to forget (gone): fingerprints now against those kept."""
    kept = done.select(F.col(key).alias("__k"), F.col("fingerprint").alias("__f"))
    rows = now.join(kept, F.col(key).eqNullSafe(F.col("__k")), "full")
    reason = F.when(F.col("__f").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") != F.col("__f"), "changed")
    return rows.select(F.coalesce(key, "__k").alias(key), reason.alias("reason")).where("reason IS NOT NULL")


class Moved(Exception):
    """Another commit came between."""


class Kept:
    """A table by key in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def commit(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:012d}", wholetext=True).first()[0])

    def _publish(self, parts: list[str]) -> int:
        version = max(self.versions(), default=0) + 1
        staged = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps({"parts": parts, "at": time.time()}).encode()))
        out.close()
        if not self._fs.rename(staged, self._path(f"{self.path}/commits/{version:012d}")):
            raise OSError(f"{self.path}: version {version} can't be written")
        return version

    def add(self, done: DataFrame, rows: DataFrame, after: int | None = None) -> int:
        """Commit a part: keys with fingerprints (null: the key is forgotten) and their rows; returns the version. With `after`, only as the next version behind that."""
        part = uuid.uuid4().hex
        done.write.parquet(f"{self.path}/parts/{part}/done")
        rows.write.parquet(f"{self.path}/parts/{part}/rows")
        with locked(self.spark, self.path):
            last = max(self.versions(), default=None)
            if after is not None and after != last:
                raise Moved(f"{self.path} is at version {last}, not {after}")
            return self._publish([*(self.commit(last)["parts"] if last else []), part])

    def _latest(self, parts: list[str]) -> DataFrame:
        every = None
        for place, part in enumerate(parts):
            df = self.spark.read.parquet(f"{self.path}/parts/{part}/done").withColumn("__part", F.lit(place))
            every = df if every is None else every.unionByName(df)
        return every.groupBy(self.key).agg(F.max_by("fingerprint", "__part").alias("fingerprint"), F.max("__part").alias("__part")).where("fingerprint IS NOT NULL")

    def done(self, version: int | None = None) -> DataFrame | None:
        """(key, fingerprint) of the version, the last one if none is named; None where there is none."""
        version = version or max(self.versions(), default=None)
        return self._latest(self.commit(version)["parts"]).drop("__part") if version else None

    def rows(self, version: int | None = None) -> DataFrame:
        """Rows of the version, the last one if none is named; later commits don't change what this reads."""
        version = version or max(self.versions(), default=None)
        if not version:
            raise FileNotFoundError(f"{self.path} has no version")
        parts = self.commit(version)["parts"]
        read = [self.spark.read.parquet(f"{self.path}/parts/{p}/rows").withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
        if len(read) == 1:
            return read[0].drop("__part")
        every = read[0]
        for more in read[1:]:
            every = every.unionByName(more, allowMissingColumns=True)
        last = self._latest(parts).select(F.col(self.key).alias("__k"), F.col("__part").alias("__p"))
        return every.join(last, F.col(self.key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left_semi").drop("__part")

    def compact(self, keep: int = 2) -> None:
        """One part instead of many; the parts of the last `keep` versions stay for their readers, other ones and their commits go."""
        version = max(self.versions())
        part = uuid.uuid4().hex
        self.done(version).write.parquet(f"{self.path}/parts/{part}/done")
        self.rows(version).write.parquet(f"{self.path}/parts/{part}/rows")
        with locked(self.spark, self.path):
            if max(self.versions()) == version:  # else a commit came between, and the next call compacts
                self._publish([part])
            versions = self.versions()
            used = {p for v in versions[-keep:] for p in self.commit(v)["parts"]}
            old = {p for v in versions[:-keep] for p in self.commit(v)["parts"]} - used
            for v in versions[:-keep]:
                self._fs.delete(self._path(f"{self.path}/commits/{v:012d}"), False)
            for p in old:
                self._fs.delete(self._path(f"{self.path}/parts/{p}"), True)


def rebuilt(table: Kept, build: Callable[[], DataFrame], max_age: float) -> DataFrame:
    """The table's rows if its last version is at most max_age seconds old; else built anew; if that fails, the last good version, with a warning."""
    last = max(table.versions(), default=None)
    if last and time.time() - table.commit(last)["at"] < max_age:
        return table.rows(last)
    try:
        rows = checkpointed(build())
        now = fingerprints(table.key, [rows])
        if last:
            gone = table.done(last).join(now, table.key, "left_anti").withColumn("fingerprint", F.lit(None).cast("string"))
            now = now.unionByName(gone)
        return table.rows(table.add(now, rows))
    except Exception as e:
        if not last:
            raise
        log.warning("%s can't be rebuilt (%s); its version %d stays", table.path, e, last)
        return table.rows(last)


@dataclass
class Stage:
    """compute gets the inputs, cut to the keys to compute, in the order of `after`; parameters take part in the fingerprint."""

    name: str
    after: Sequence[str]
    compute: Callable[..., DataFrame]
    parameters: Mapping = field(default_factory=dict)


class Flow:
    def __init__(self, spark: SparkSession, root: str, key: str, stages: Sequence[Stage]) -> None:
        self.spark, self.key, self.stages = spark, key, stages
        self.tables = {s.name: Kept(spark, f"{root}/{s.name}", key) for s in stages}

    def edges(self) -> DataFrame:
        return self.spark.createDataFrame([(b, s.name) for s in self.stages for b in s.after], "before string, after string")

    def run(self, sources: Mapping[str, DataFrame], batches: int = 1) -> dict[str, DataFrame]:
        """The rows of every stage. Only stale keys are computed, in batches that are each committed: a run that was killed goes on where it was."""
        frames = dict(sources)
        for stage in self.stages:
            table, inputs = self.tables[stage.name], [frames[n] for n in stage.after]
            now = checkpointed(fingerprints(self.key, inputs, stage.parameters))
            done = table.done()
            todo = checkpointed(stale(now, done if done is not None else now.limit(0), self.key))
            if done is None or not todo.isEmpty():
                for k in range(batches):
                    mine = todo.where(F.pmod(F.xxhash64(self.key), F.lit(batches)) == k)
                    keys = mine.where("reason <> 'gone'").select(self.key)
                    rows = stage.compute(*[df.join(keys, self.key, "left_semi") for df in inputs])
                    finished = mine.select(self.key).join(now, self.key, "left")
                    table.add(finished, rows)
            frames[stage.name] = table.rows()
        return {s.name: frames[s.name] for s in self.stages}

    def redo(self, shows: DataFrame, stage: str, keep: Sequence[str] = (KEPT,)) -> dict[str, int]:
        """Forget the shows' results of a stage and of all that depends on it, but for kept ones; the next run computes these. How many, by stage."""
        if stage not in self.tables:
            raise ValueError(f"unknown stage {stage!r}; there are {', '.join(self.tables)}")
        gone = checkpointed(touched(shows.select(self.key, F.lit(stage).alias("stage")).distinct(), self.edges(), self.key, "stage", keep))
        counts = {}
        for name, table in self.tables.items():
            done = table.done()
            if done is None:
                continue
            mine = checkpointed(done.join(gone.where(F.col("stage") == name), self.key, "left_semi"))
            if counts_of := mine.count():
                table.add(mine.withColumn("fingerprint", F.lit(None).cast("string")), table.rows().limit(0))
                counts[name] = counts_of
        return counts
