"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Texts are equal when they agree after deleting every separator. Three filters
narrow the rows, each paid for only by what the last one left:

1. rows are counted by (length, hash of a prefix) with map-side combining, so a
   group of any size is one row a task; lengths and then prefixes with a single
   row leave;
2. the keys that survive set bits in a bitmap of bounded size (2 to 32 MB, by
   their number), which is broadcast. A row whose bit is clear is unique: it is kept
   at once, without a full hash and without a shuffle. A bit set by another key
   only costs a needless hash;
3. the other rows are hashed in full and grouped by that hash; the winner of
   each group is joined back over a hash of the key, so that adaptive execution
   can split the partition of a large group.

Defined results: a null text counts as empty, all empty texts are one group; a
null id sorts after every other; rows repeating an id and a text share the
decision of that id; an empty table gives no rows; input columns named like
results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import bitmap_of, checkpointed, marked, parts_for, text_of, with_result, without_white

RESULTS = ("keep_id", "group_size", "kept")


def surviving_keys(docs: DataFrame, text_col: str = "text", prefix: int = 64) -> DataFrame:
    """(nlen, ph) of the groups that length and prefix hash leave with more than one row."""
    norm = without_white(text_of(text_col))
    counted = docs.select(F.length(norm).alias("nlen"), F.xxhash64(F.substring(norm, 1, prefix)).alias("ph")).groupBy("nlen", "ph").agg(F.count(F.lit(1)).alias("n"))
    # a length with one row has one prefix with one row: the second filter contains the first
    return counted.where("n > 1").select("nlen", "ph")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, prefix: int = 64) -> DataFrame:
    """Every row of docs with keep_id, group_size and kept; carry: the input columns to return (all by default).

    Of equal texts, the row with the most code points, then the smallest id, stays.
    """
    keep = with_result(docs, docs.columns if carry is None else carry, RESULTS)
    alone, held = decided(docs, id_col, text_col, keep, prefix)
    return alone.unionByName(held.drop("__full", "__chars"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """One row of docs for each text: the row that exact_dedup() keeps, and where rows repeat its id, one of them.

    Of these, the row with the most code points, then the least by its columns in order, stays.
    """
    alone, held = decided(docs, id_col, text_col, docs.columns, prefix, "__")
    order = Window.partitionBy("__full").orderBy(F.col("__chars").desc(), *[F.col(c) for c in docs.columns])
    held = held.where("__kept").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return alone.select(*docs.columns).unionByName(held.select(*docs.columns))


def decided(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str], prefix: int, before: str = "") -> tuple[DataFrame, DataFrame]:
    """Columns keep and results, named with `before`, of rows whose text surely is the only one, and of others; these with __full and __chars."""
    key = F.xxhash64("__nlen", "__ph")
    surviving = checkpointed(surviving_keys(docs, text_col, prefix).select(F.col("nlen").alias("__nlen"), F.col("ph").alias("__ph")))
    parts = parts_for(surviving.count())
    bitmap = bitmap_of(surviving, key, parts)

    norm = without_white(text_of(text_col))
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in keep], F.col(id_col).alias("__id"), F.length(text_of(text_col)).alias("__chars"), norm.alias("__norm"))
    rows = rows.withColumns({"__nlen": F.length("__norm"), "__ph": F.xxhash64(F.substring("__norm", 1, prefix))})
    rows = marked(rows, key, bitmap, "__shared", parts)
    out = [F.col(f"c_{c}").alias(c) for c in keep]

    alone = rows.where(~F.col("__shared")).select(*out, F.col("__id").alias(f"{before}keep_id"), F.lit(1).cast("long").alias(f"{before}group_size"), F.lit(True).alias(f"{before}kept"))

    held = rows.where("__shared").select(*[f"c_{c}" for c in keep], "__id", "__chars", F.sha2("__norm", 256).alias("__full"))
    first = F.struct(-F.col("__chars"), F.col("__id").isNull(), F.col("__id").alias("id"))
    groups = held.groupBy("__full").agg(F.min(first).alias("__first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("__full").alias("__g"), F.xxhash64("__full").alias("__gk"), F.col("__first.id").alias("keep_id"), "group_size")
    held = held.withColumn("__k", F.xxhash64("__full")).join(groups, (F.col("__k") == F.col("__gk")) & (F.col("__full") == F.col("__g")))
    held = held.select(*out, F.col("keep_id").alias(f"{before}keep_id"), F.col("group_size").alias(f"{before}group_size"), F.col("__id").eqNullSafe(F.col("keep_id")).alias(f"{before}kept"), "__full", "__chars")
    return alone, held
