"""Sinks: appends that can be repeated, deletes by rewriting, artifacts, gated delivery."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.operators.catalog import append_once
from stagewise.operators.guards import refusals


def _replace(spark, staged: str, path: str) -> None:
    """Put a staged folder in a path's place, through Hadoop's file system, wherever the path is."""
    jvm = spark._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path}-old-{uuid.uuid4().hex}")
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(source, target)
    fs.delete(old, True)


def write_artifact(df: DataFrame, path: str) -> None:
    """df as Parquet, complete or not at all: staged beside the path, then renamed under the path's lock."""
    staged = f"{path}-new-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    with locked(df.sparkSession, path):
        _replace(df.sparkSession, staged, path)


@contextmanager
def locked(spark: SparkSession, path: str, patience: float = 60.0, stale: float = 3600.0) -> Iterator[None]:
    """Holds the path's lock: a file that only one writer can create, on HDFS, any other of Hadoop's file systems that create atomically, or one machine's disk.

    Waits while another holds it, then raises TimeoutError; a lock older than `stale` seconds is of a writer that died, and goes.
    """
    jvm = spark._jvm
    lock = jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(lock.getParent())
    end = time.monotonic() + patience
    while True:
        try:
            if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
                os.close(os.open(lock.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            else:
                fs.create(lock, False).close()
            break
        except Exception as e:
            try:
                old = time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale
            except Exception:
                old = False  # it is gone by now
            if old:
                fs.delete(lock, False)
            elif time.monotonic() > end:
                raise TimeoutError(f"{path} is locked") from e
            else:
                time.sleep(0.05)
    try:
        yield
    finally:
        fs.delete(lock, False)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def record(ledger_path: str, new: DataFrame, keys: list[str], position: str) -> None:
    """Append the rows of new whose keys the ledger lacks; a second call, at the same time or later, adds nothing."""
    spark = new.sparkSession
    with locked(spark, ledger_path):
        old = spark.read.schema(new.schema).json(ledger_path) if _exists(spark, ledger_path) else new.limit(0)
        append_once(old, new, keys, position).write.mode("append").json(ledger_path)


def remove(ledger_path: str, schema: str, which: Column) -> int:
    """Delete the rows of a JSON ledger that `which` holds for; returns how many."""
    spark = SparkSession.active()
    with locked(spark, ledger_path):
        rows = spark.read.schema(schema).json(ledger_path)
        gone = rows.where(which).count()
        if gone:
            staged = f"{ledger_path}-new-{uuid.uuid4().hex}"
            rows.where(~F.coalesce(which, F.lit(False))).write.json(staged)
            _replace(spark, staged, ledger_path)
    return gone


#: The dispositions of a performance in the ledger.
PLAYED, REJECTED = ("selected", "delivered"), "rejected"


def forget(ledger_path: str, schema: str, key: str, value: str) -> int:
    """Delete every row of a performance: it may be found again."""
    return remove(ledger_path, schema, F.col(key) == value)


def suppress(ledger_path: str, rows: DataFrame, keys: list[str], position: str, status: str = "status") -> None:
    """Record performances as rejected: they aren't found again."""
    record(ledger_path, rows.withColumn(status, F.lit(REJECTED)), [*keys, status], position)


def unsuppress(ledger_path: str, schema: str, key: str, value: str, status: str = "status") -> int:
    """Delete a performance's rejection; what was played stays."""
    return remove(ledger_path, schema, (F.col(key) == value) & (F.col(status) == REJECTED))


def forget_all(ledger_path: str, schema: str, key: str, gone: DataFrame) -> int:
    """Delete every row of the performances in gone, a frame of one column; returns how many rows."""
    spark = gone.sparkSession
    with locked(spark, ledger_path):
        if not _exists(spark, ledger_path):
            return 0
        rows = spark.read.schema(schema).json(ledger_path)
        named = gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()
        n = rows.join(named, F.col(key) == F.col("__gone"), "left_semi").count()
        if n:
            staged = f"{ledger_path}-new-{uuid.uuid4().hex}"
            rows.join(named, F.col(key) == F.col("__gone"), "left_anti").write.json(staged)
            _replace(spark, staged, ledger_path)
    return n


def rewrite_blocks(document: str, **blocks) -> str:
    """A JSON object with exactly these keys replaced, and new ones added at its end; every other character stays as it is."""
    read, blank = json.JSONDecoder(), " \t\r\n"

    def past_blanks(at: int) -> int:
        while document[at] in blank:
            at += 1
        return at

    at = past_blanks(0)
    if document[at] != "{":
        raise ValueError("not a JSON object")
    spans: dict[str, tuple[int, int]] = {}
    last, indent = at + 1, ""
    at = past_blanks(at + 1)
    while document[at] != "}":
        if not spans:
            indent = document[last:at]
        key, at = read.raw_decode(document, at)
        at = past_blanks(past_blanks(at) + 1)
        _, end = read.raw_decode(document, at)
        spans[key] = (at, end)
        last, at = end, past_blanks(end)
        at = past_blanks(at + 1) if document[at] == "," else at
    edits = [(*spans.get(k, (last, last)), k, json.dumps(v, ensure_ascii=False)) for k, v in blocks.items()]
    new = [(k, v) for i, j, k, v in edits if k not in spans]
    added = ",".join(f"{indent}{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in new)
    out = document[:last] + ("," if spans and added else "") + added + document[last:]
    for i, j, k, v in sorted((e for e in edits if e[2] in spans), reverse=True):
        out = out[:i] + v + out[j:]
    return out


def delivery(df: DataFrame, legs: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be delivered, refused rows with reasons)."""
    rows = df.withColumn("reasons", refusals(legs))
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def duration_mismatches(packaged: DataFrame, key: str, real: str, said: str, tolerance: float = 5.0) -> DataFrame:
    return packaged.where(F.abs(F.col(real) - F.col(said)) > tolerance).select(key, real, said)
