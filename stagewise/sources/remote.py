"""A Python data source over a paged, cursor-driven catalog.

The transport is a function (query, cursor) -> (rows, next cursor), named by its import
path, so that readers on executors can load it. Each query is a partition. Pages are
fetched with a pause between requests, as many times longer as partitions may run at
once (option readers, all of them by default), so the service sees one rate; failures that may pass are tried again with
doubling waits; refusals end the scan.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stagewise.operators.sinks import locked
from stagewise.shipping import checkpointed
from stagewise.sources.scans import missing_from_cache


class Refused(Exception):
    """The request itself is wrong: trying again won't help."""


def fetch(call: Callable, *args, tries: int = 3, wait: float = 1.0, pause: float = 0.0):
    """call(*args), tried again with doubling waits unless refused."""
    for k in range(tries):
        try:
            time.sleep(pause)
            return call(*args)
        except Refused:
            raise
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)


class QueryPartition(InputPartition):
    def __init__(self, query: str) -> None:
        self.query = query


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.queries = json.loads(options.get("queries", '[""]'))
        self.transport = options["transport"]
        self.pause, self.tries, self.wait = float(options.get("pause", 0.5)), int(options.get("tries", 5)), float(options.get("wait", 2))
        self.pause *= max(1, min(len(self.queries), int(options.get("readers", len(self.queries)))))

    def partitions(self) -> list[InputPartition]:
        return [QueryPartition(q) for q in self.queries]

    def read(self, partition: QueryPartition) -> Iterator[tuple]:
        call = called(self.transport)
        cursor = None
        while True:
            rows, cursor = fetch(call, partition.query, cursor, tries=self.tries, wait=self.wait, pause=self.pause)
            for row in rows:
                yield (partition.query, json.dumps(row))
            if not cursor:
                return


class Span(InputPartition):
    """What came to a query's feed behind one cursor, up to another."""

    def __init__(self, query: str, start: str | None, end: str) -> None:
        self.query, self.start, self.end = query, start, end


class CatalogStreamReader(DataSourceStreamReader):
    """Feeds that only grow, read as they grow. The offset is each query's cursor, so a restart goes on where the last batch ended, and a batch that is
    replayed reads what it read before.

    Options head: a function (query) -> the cursor of the feed's end, null where it is empty; transport: (query, cursor, end) -> (rows, next cursor),
    rows behind the cursor (null: from the beginning) in pages, none of them behind `end`, which is the last page's next cursor.
    A query that is new at a restart starts at its beginning; one that is left out for a while does so, too.
    """

    def __init__(self, options: dict) -> None:
        self.queries = json.loads(options.get("queries", '[""]'))
        self.transport, self.head = options["transport"], options["head"]
        self.fetching = {"tries": int(options.get("tries", 5)), "wait": float(options.get("wait", 2)), "pause": float(options.get("pause", 0.5))}
        self.reading = self.fetching | {"pause": self.fetching["pause"] * max(1, min(len(self.queries), int(options.get("readers", len(self.queries)))))}

    def initialOffset(self) -> dict:
        return {q: None for q in self.queries}

    def latestOffset(self) -> dict:
        call = called(self.head)
        return {q: fetch(call, q, **self.fetching) for q in self.queries}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Span(q, start.get(q), cursor) for q, cursor in end.items() if cursor is not None and cursor != start.get(q)]

    def read(self, partition: Span) -> Iterator[tuple]:
        call, cursor = called(self.transport), partition.start
        while cursor != partition.end:
            rows, cursor = fetch(call, partition.query, cursor, partition.end, **self.reading)
            for row in rows:
                yield (partition.query, json.dumps(row))
            if cursor is None:
                raise LookupError(f"the feed of {partition.query!r} ends before {partition.end}: it has lost rows")


class CatalogSource(DataSource):
    """spark.dataSource.register(CatalogSource); spark.read.format("catalog").options(transport=..., queries='["a", "b"]').load()

    As a stream, with the option head: spark.readStream.format("catalog").options(transport=..., head=...).load() (CatalogStreamReader).
    """

    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return "query string, record string"

    def reader(self, schema) -> DataSourceReader:
        return CatalogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CatalogStreamReader(self.options)


def search(spark: SparkSession, transport: Callable, query: str, rows: int = 500, **options) -> DataFrame:
    """(query, record) of the first page that a query finds, `rows` at most."""
    found, _ = fetch(transport, query, None, **options)
    return spark.createDataFrame([(query, json.dumps(x)) for x in found[:rows]], "query string, record string")


def called(name: str) -> Callable:
    """The function of an import path."""
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def read_through(wanted: DataFrame, cache_path: str, key: str, transport: str | Callable, tries: int = 3, wait: float = 1.0, pause: float = 0.5, readers: int = 4, patience: float = 3600.0) -> DataFrame:
    """key, record, error: a row for every wanted key but null, from the cache at the path, else fetched by transport(key), at most `readers` at once, and added to it.

    Keys that are refused or go on failing have the error and no record, and aren't cached: the next call asks again.
    One call at a time fetches for a cache, so that no key is asked for or kept twice; others wait `patience` seconds.
    """
    spark = wanted.sparkSession
    schema = f"`{key}` string, record string"
    keys = wanted.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = called(transport) if isinstance(transport, str) else transport
        for batch in batches:
            got = []
            for k in batch.column(0).to_pylist():
                try:
                    got.append((k, json.dumps(fetch(call, k, tries=tries, wait=wait, pause=pause * readers)), None))
                except Exception as e:
                    got.append((k, None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in got], pa.string()) for n in range(3)], names=[key, "record", "error"])

    with locked(spark, cache_path, patience, stale=24 * patience):
        there = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
        cached = spark.read.schema(schema).parquet(cache_path) if exists else spark.createDataFrame([], schema)
        asked = checkpointed(missing_from_cache(keys, cached, key).repartition(readers).mapInArrow(run, f"{schema}, error string"))
        asked.where("error is null").select(key, "record").write.mode("append").parquet(cache_path)
    kept = spark.read.schema(schema).parquet(cache_path).join(keys.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "left_semi")
    failed = asked.where("error is not null")
    return kept.dropDuplicates([key]).withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def verified(files: DataFrame, content: str, md5: str) -> tuple[DataFrame, DataFrame]:
    """(files whose bytes have the md5 that is said of them, or of which none is said; the others)."""
    bad = F.coalesce(F.md5(content) != F.lower(F.col(md5)), F.lit(False))
    return files.where(~bad), files.where(bad)
