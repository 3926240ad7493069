"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.shipping import ship

#: The six characters that separate words everywhere in this subpackage.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A word, in the syntax of Java, Python and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_white(column: Column) -> Column:
    """The text without any of the six separators; replace() scans bytes and beats a regular expression. Most texts have the first two only."""
    without = lambda signs: reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), signs, column)
    return F.when(column.rlike(r"[\t\x0b\x0c\r]"), without(WHITE)).otherwise(without((" ", "\n")))


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def with_result(df: DataFrame, carry: Iterable[str], results: Iterable[str]) -> list[str]:
    """The input columns to keep beside result columns; on a clash of names the result wins."""
    taken = {r.lower() for r in results}
    return [c for c in carry if c.lower() not in taken]


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share, so that lost executors cost no recomputation.

    The folder is spark.checkpoint.dir of the session. Where it is unset, a temporary one serves a local master (tests on
    one machine); on a cluster that is an error, since other executors can't read it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "stagewise-checkpoints"))
    return df.checkpoint(eager=True)


#: Bits of a part of a bitmap: what bitmap_construct_agg() fills; parts of a bitmap: 2 MB in all, 32 MB at most.
PART_BITS, PARTS, MOST_PARTS = 32768, 512, 8192


def parts_for(keys: int) -> int:
    """Parts of a bitmap with about 8 bits a key, within the bounds."""
    return max(PARTS, min(MOST_PARTS, 1 << max(0, (8 * keys // PART_BITS)).bit_length()))


def bitmap_of(keys: DataFrame, hashed: Column, parts: int = PARTS) -> DataFrame:
    """A bitmap of bounded size, whatever the input, with the bits of all hashed keys set: (__part, __bitmap)."""
    at = F.pmod(hashed, F.lit(parts * PART_BITS))
    return keys.select(F.floor(at / PART_BITS).cast("int").alias("__part"), (at % PART_BITS).alias("__at")).groupBy("__part").agg(F.expr("bitmap_construct_agg(__at)").alias("__bitmap"))


def marked(rows: DataFrame, hashed: Column, bitmap: DataFrame, flag: str, parts: int = PARTS) -> DataFrame:
    """rows with a flag: whether the bit of the hashed key is set. All keys of the bitmap are found; some others, too."""
    rows = rows.withColumn("__bit", F.pmod(hashed, F.lit(parts * PART_BITS)))
    rows = rows.join(F.broadcast(bitmap), F.floor(F.col("__bit") / PART_BITS).cast("int") == F.col("__part"), "left")
    rows = rows.withColumn("__byte", F.conv(F.hex(F.expr(f"substring(__bitmap, cast((__bit % {PART_BITS}) div 8 + 1 as int), 1)")), 16, 10).cast("int"))
    return rows.withColumn(flag, F.coalesce(F.expr("shiftright(__byte, cast(__bit % 8 as int)) & 1") == 1, F.lit(False))).drop("__bit", "__part", "__bitmap", "__byte")


def byte_slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 1 << 20, most_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column `text` of one has most_bytes at most (or is one row)."""
    for batch in batches:
        k = 0
        while k < batch.num_rows:
            n, size = 0, 0
            for x in batch.column(text).slice(k, most_rows):
                size += len(x.as_buffer()) if x.is_valid else 0
                if n and size > most_bytes:
                    break
                n += 1
            yield batch.slice(k, n)
            k += n


class Union(dict):
    """Union-find; the least member names a class."""

    def find(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            self[x] = x = self.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


#: Edges that one task contracts.
CHUNK_EDGES = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each partition as stars around the least member of what they connect there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, seen = Union(), set()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u.join(x, y)
                seen.add(x)
                seen.add(y)
        stars = [(r, v) for v in seen if (r := u.find(v)) != v]
        for k in range(0, len(stars), 100_000):
            a, b = zip(*stars[k : k + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): every id in an edge (a, b), a <> b, with the least id that it reaches.

    Chunks of bounded size are contracted to stars, each in a task. Where there is more than one chunk, rounds follow
    until no edge moves: every edge's lesser end, then every lesser end of the same id, gives way to the least
    neighbour. Moves keep what is connected, take ids down, so they end, and none is left only where all edges are
    stars around the least id. Rounds grow with the logarithm of the ids, in any order of them. Neighbours are never
    gathered, only the least one, with map-side combining, and each step is written out.
    """
    ship(edges.sparkSession)
    edges = checkpointed(edges.select("a", "b").where("a != b"))
    chunks = max(1, -(-edges.count() // CHUNK_EDGES))
    stars = checkpointed(contracted(edges.coalesce(chunks)).select(F.col("b").alias("v"), F.col("a").alias("w")))  # w < v

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("least")).select(F.col("v").alias("of"), "least")

    def both() -> DataFrame:
        return stars.select("v", "w").union(stars.select(F.col("w").alias("v"), F.col("v").alias("w")))

    def once(pairs: DataFrame) -> DataFrame:
        return checkpointed(pairs.groupBy("v", "w").agg(F.max("moved").alias("moved")))

    moving = chunks > 1
    while moving:
        moved = F.col("w") != F.col("least")
        stars = once(stars.join(least(both()), F.col("w") == F.col("of")).select("v", F.col("least").alias("w"), moved.alias("moved")))
        near = stars.join(least(stars), F.col("v") == F.col("of"))
        stars = once(near.select(F.when(moved, F.col("w")).otherwise(F.col("v")).alias("v"), F.col("least").alias("w"), (F.col("moved") | moved).alias("moved")))
        moving = not stars.where("moved").isEmpty()
    return checkpointed(least(both()).select(F.col("of").alias("v"), F.col("least").alias("label")))
