"""Importance resampling towards a target distribution.

Features are runs of words, hashed to buckets. Identical texts are collapsed
first, by grouping the full texts with map-side combining, so that a text's
features are computed once and its counts enter multiplied by how many rows
have it. The features of each text are written out as bucket numbers; from
them come, in one pass, the counts of all buckets of the documents, and the same
for the target; the gain of a bucket is the logarithm of the target's smoothed
share over the documents'. In a second pass over the written numbers each text
gets the sum of its features' gains, its weight. Weights go back to the rows by the
texts' digests: those of texts that hold a ten-thousandth of all rows or more are
broadcast (so there are ten thousand at most), the others are joined, so no key
of that join is hot. Only then each row gets its own noise, by its id.

Drawing without replacement takes the highest sums of weight and Gumbel noise. Rows
are sorted once by ranges; a row's rank is what lies in earlier ranges plus its
place in its own, so no task sees more than a range.

Defined results: a null text counts as empty, without words; texts without words have
no features and weigh 0; a null id counts as an empty one in its noise and comes last among
ties; rows that repeat an id and a text are ranked in some order; an empty table gives no rows,
and an empty target is one without features; of input columns, those in `carry` are kept, unless a result has
the name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import byte_slices, checkpointed, ship, text_of, with_result
from stagewise.llm.words import BYTES, NOT_ALPHANUMERIC, over_bytes, word_spans

#: Texts with this share of all rows or more have their weight broadcast.
SHARE = 10_000
RESULTS = ["n_words", "n_features", "weight", "score", "rank"]


def _crc_steps() -> np.ndarray:
    """What a byte does to a state of CRC-32, from its polynomial."""
    x = BYTES.astype(np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1)
    return x.astype(np.uint32)


CRC = _crc_steps()
ONES = np.uint32(0xFFFFFFFF)


def _step(h: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return CRC[(h ^ b) & 255] ^ h >> np.uint32(8)


def features(texts: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, features of each text, words of each text): runs of 1 to `most` words, by the CRC-32 of the words joined by one space.

    A run's checksum goes on from that of the run without its last word.
    """
    data, first, length, words = word_spans(texts, True, NOT_ALPHANUMERIC)
    of = np.repeat(np.arange(len(words)), words)
    at, state = np.arange(len(first)), np.full(len(first), ONES)
    found, owner = [], []
    for k in range(most):
        if k:  # only runs that have one more word behind them in their text
            on = at + k < len(of)
            on[on] = of[at[on] + k] == of[at[on]]
            at, state = at[on], _step(state[on], 32)
        state = over_bytes(data, first[at + k], length[at + k], state, _step, lambda h, word: np.uint32(zlib.crc32(word, int(h) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF))
        found.append((state ^ ONES).astype(np.int64) % buckets)
        owner.append(of[at])
    bucket, owner = np.concatenate(found), np.concatenate(owner)
    if most > 1:
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
    return bucket, np.bincount(owner, minlength=len(words)), words


def feature_lists(docs: DataFrame, text_col: str, most: int, buckets: int) -> DataFrame:
    """key (digest of the text), m (rows that have it), n_words, n_features and buckets (packed numbers) of every distinct text."""
    ship(docs.sparkSession)
    kind = np.int16 if buckets <= 1 << 15 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_slices(batches, 2):
            bucket, n, words = features(rows.column(2), most, buckets)
            data, ends = bucket.astype(kind).tobytes(), np.cumsum(n) * kind().itemsize
            lists = [data[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(lists, pa.binary())], names=["key", "m", "n_words", "n_features", "buckets"])

    texts = docs.select(text_of(text_col).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("m"))
    return texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "m", "text").mapInArrow(run, "key binary, m long, n_words long, n_features long, buckets binary")


def _numbers(lists: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(lists.to_pylist()), np.int16 if buckets <= 1 << 15 else np.int32)


def bucket_counts(lists: DataFrame, buckets: int) -> DataFrame:
    """bucket, held: features in each bucket that has any, repeats and copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for rows in batches:
            m, n = (np.asarray(rows.column(k)) for k in (0, 1))
            held += np.bincount(_numbers(rows.column(2), buckets), np.repeat(m, n), buckets).astype(np.int64)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "held"])

    return lists.select("m", "n_features", "buckets").mapInArrow(run, "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from counts (bucket, held) of both sides; `buckets` numbers, whatever the input."""
    spark = docs.sparkSession
    both = docs.withColumnRenamed("held", "s").join(target.withColumnRenamed("held", "t"), "bucket", "full").na.fill(0)
    both = checkpointed(both)
    of_docs, of_target = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    all_buckets = spark.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left").na.fill(0)
    share = ((F.col("t") + 1) * F.lit(of_docs + buckets).cast("long")).cast("double") / ((F.col("s") + 1) * F.lit(of_target + buckets).cast("long")).cast("double")
    out = np.zeros(buckets, np.int64)
    for r in all_buckets.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weighed(lists: DataFrame, gains: np.ndarray) -> DataFrame:
    """key, m, n_words, n_features and weight (the sum of its features' gains) of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sums = np.concatenate([[0], np.cumsum(gains[_numbers(rows.column(4), len(gains))])])
            ends = np.cumsum(np.asarray(rows.column(3)))
            weight = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else ends
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(weight, pa.int64())], names=["key", "m", "n_words", "n_features", "weight"])

    return lists.mapInArrow(run, "key binary, m long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int):
    """Gumbel noise of an id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row; rows with a rank are drawn: percent of those with least_words words or more."""
    keep = with_result(docs, dict.fromkeys([id_col, *carry]), RESULTS)
    lists = checkpointed(feature_lists(docs, text_col, most, buckets))
    gains = bucket_gains(bucket_counts(lists, buckets), bucket_counts(feature_lists(target, text_col, most, buckets), buckets), buckets)
    weights = checkpointed(weighed(lists, gains))
    rows, eligible = weights.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_words") >= least_words, F.col("m"))), F.lit(0))).first()

    weights = weights.withColumnRenamed("key", "__key")
    held = F.col("m") * SHARE >= rows
    hot, rest = weights.where(held).drop("m"), weights.where(~held).drop("m")
    keyed = checkpointed(docs.select(*keep, F.unhex(F.sha2(text_of(text_col), 256)).alias("__of")))
    same = F.col("__of") == F.col("__key")
    joined = keyed.join(F.broadcast(hot), same).unionByName(keyed.join(F.broadcast(hot.select("__key")), same, "left_anti").join(rest, same))
    scored = checkpointed(joined.select(*keep, "n_words", "n_features", "weight", (F.col("weight") + noise(id_col, seed)).alias("score")))

    order = [F.desc(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last(id_col)]
    placed = checkpointed(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.join(F.broadcast(parts), part == F.col("__part"))
    return ranked.select(*keep, "n_words", "n_features", "weight", "score", F.when(rank <= percent * eligible // 100, rank).alias("rank"))
