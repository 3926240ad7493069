"""Structured Streaming over ledgers and packages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def ledger_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def append_once_stream(rows: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """Each key once within the watermark: duplicates that come later than it are dropped as late, so state stays bounded."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def counts_by_window(rows: DataFrame, at: str, late: str, width: str, *keys: str) -> DataFrame:
    """Rows by tumbling window of event time and keys."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *keys).count().select(F.col("window.start").alias("start"), *keys, F.col("count").alias("n"))


def poll(pending: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, done: str, failed: str, checkpoint: str) -> StreamingQuery:
    """Process what is new, then stop. A batch that fails is halved by hashes of its keys until the bad keys are alone; these go to `failed` with the error.

    b bad keys of n take about 2 b log2(n) jobs. work: a DataFrame to a DataFrame; done, failed: Parquet folders. A batch that
    runs twice writes under its own number, replacing what it wrote before.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        bad = []

        def part(rows: DataFrame, level: int) -> None:
            try:
                work(rows).write.mode("append" if level else "overwrite").parquet(f"{done}/batch={number}")
            except Exception as e:
                if not level:  # what an earlier run of this batch wrote goes
                    work(rows.limit(0)).write.mode("overwrite").parquet(f"{done}/batch={number}")
                keys = rows.select(key).distinct().take(2)
                if len(keys) < 2:
                    bad.extend((None if k[0] is None else str(k[0]), f"{type(e).__name__}: {e}"[:500]) for k in keys)
                    return
                if level == 64:
                    raise  # different keys with one hash
                bit = F.shiftrightunsigned(F.xxhash64(key), level).bitwiseAND(F.lit(1).cast("long"))
                for half in (0, 1):
                    rest = rows.where(bit == half)
                    if not rest.isEmpty():
                        part(rest, level + 1)

        try:
            part(batch, 0)
            if bad:
                batch.sparkSession.createDataFrame(bad, "key string, error string").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        finally:
            batch.unpersist()

    return pending.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_key(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """The latest value of each key, in a streaming aggregation whose state is one row a key (output mode complete or update)."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, value)).alias("b")).select(key, F.col(f"b.{value}").alias(value))


def _sortable(c: Column, kind: str) -> Column:
    """Text that sorts like the value: pandas would make floats of whole numbers beside nulls, and lose the zone of timestamps."""
    if kind == "string":
        return c
    number = F.unix_micros(c) if kind == "timestamp" else F.unix_date(c) if kind == "date" else c
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def _unsorted(c: Column, kind: str) -> Column:
    if kind == "string":
        return c
    number = F.conv(c, 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.timestamp_micros(number) if kind == "timestamp" else F.date_from_unix_date(number.cast("int")) if kind == "date" else number.cast(kind)


def latest_stream(rows: DataFrame, key: str, order: Sequence[str], value: str, idle: int | None = None) -> DataFrame:
    """key, the order columns and value: a row whenever a key's latest value changes (output mode update).

    Order columns are compared one after the other, nulls first; of rows that are equal in all of them the greatest value counts, as
    in `latest_by_key`. Rows that come late or again change nothing, whenever they come. State is one row a key; with `idle`, the
    milliseconds after which a key that isn't seen leaves it, the reader of the rows takes each key's greatest order, and the query
    runs until it is stopped: with a time-out pending, a trigger of availableNow doesn't end. Rows without a
    key are one key. Order columns and value are strings, integers, dates or timestamps.
    """
    columns = [*order, value]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in columns}
    text = rows.select(key, *[_sortable(F.col(c), kinds[c]).alias(f"__{k}") for k, c in enumerate(columns)])
    names = [f"__{k}" for k in range(len(columns))]
    state_schema = ", ".join(f"{n} string" for n in names)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {state_schema}"
    rank = lambda row: tuple((x is not None, x or "") for x in row)

    def latest(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        before = best = tuple(state.get) if state.exists else None
        for batch in batches:
            for row in batch[names].astype(object).where(batch[names].notna(), None).itertuples(index=False, name=None):
                if best is None or rank(row) > rank(best):
                    best = row
        if idle is not None:
            state.setTimeoutDuration(idle)
        if best != before:
            state.update(best)
            yield pd.DataFrame([(*group, *best)], columns=[key, *names])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    changed = text.groupBy(key).applyInPandasWithState(latest, schema, state_schema, "update", timeout)

    return changed.select(key, *[_unsorted(F.col(n), kinds[c]).alias(c) for n, c in zip(names, columns, strict=True)])
