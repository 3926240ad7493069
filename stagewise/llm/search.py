"""Ranked lexical search by the three-phase uniform threshold algorithm (TPUT) over term-partitioned postings.

Index. One pass over the texts writes, for each document, its number of terms and
its occurrences of each term that any item asks for. What a term gives to a document's
score is the term's weight times a part that depends on the document alone, so
postings hold that part. Tasks pack the postings of their documents by term, in falling
order, the packs are shuffled by (term, lot), where a term has as many lots as it has
times `entries` postings, and each lot becomes one list in falling order. A term in
every document is thus many lists of bounded size.

Search, for all items at once.
1. Heads: the first `top` entries of each term. Their sums, by item and document, give each
   item a lower bound: its top-th best sum.
2. Threshold: one number for all lists of an item, the largest one such that a document under
   it in all lists stays under the lower bound (a list whose head is lower counts with that head; where no
   head is lower, this is the bound divided by the number of lists). Entries from the threshold on are
   fetched, each list once, down to the lowest threshold of the items that ask for it. They go, packed, to the
   share of documents they belong to, where one task sums them up for each item: these sums are better lower bounds, and
   with what lists may still add that don't show a document, upper bounds. Documents whose upper bound is under the
   item's top-th lower bound go.
3. Look-up: the remaining documents' exact scores, from the written occurrences.

Every document that is dropped has a proven bound below `top` others, so the result is exact
(terms are told apart by 64-bit hashes).

Defined results: a null text counts as empty; documents and items without terms match nothing;
rows that repeat an id are documents (or items) of their own, in some order among equal scores; null ids are
kept, the last among equal scores; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import bitmap_of, byte_slices, checkpointed, marked, parts_for, ship
from stagewise.llm.words import NOT_ALPHANUMERIC, hashed_words, mixed

#: Terms of items that are sent to all tasks (8 bytes each), items that meet a list or a document at once.
MOST_TERMS, MOST_ITEMS = 1_000_000, 1000
#: Rows of small tables that are broadcast; more are joined.
MOST_ROWS = 100_000


def _lists(values: np.ndarray, counts: np.ndarray, kind: type) -> pa.Array:
    """Packed numbers, so many for each row."""
    data, ends = values.astype(kind).tobytes(), np.cumsum(counts) * kind().itemsize
    return pa.array([data[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else [], pa.binary())


def occurrences(texts: DataFrame, id_col: str, text_col: str, only: np.ndarray | None = None) -> DataFrame:
    """id, row (a number of the row's own), n (terms with repeats), terms and tf (packed hashes and counts); only: terms to keep, sorted."""
    ship(texts.sparkSession)
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_slices(batches, 2):
            n, terms, tf = [], [], []
            for h in hashed_words(rows.column(2), True, NOT_ALPHANUMERIC):
                n.append(len(h))
                if only is not None and len(h):
                    h = h[only[np.searchsorted(only, h).clip(0, max(0, len(only) - 1))] == h] if len(only) else h[:0]
                t, c = np.unique(h, return_counts=True)
                terms.append(t.tobytes())
                tf.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], names=["id", "row", "n", "terms", "tf"])

    rows = texts.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row long, n long, terms binary, tf binary")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term) of each distinct term, from occurrences()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = [len(x) // 8 for x in rows.column(1).to_pylist()]
            terms = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(rows.column(0)), sizes)), pa.array(terms)], names=["item", "term"])

    return items.select("row", "terms").mapInArrow(run, "item long, term long")


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting gives for each unit of its term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _length_norm(n: np.ndarray, documents: int, length: int, b: int = 50) -> np.ndarray:
    """100 times a document's length norm, from its terms, the number of documents and all their terms."""
    return 100 - b + (b * n * documents) // max(length, 1)


def packs(docs: DataFrame, documents: int, length: int, postings: int = 2_000_000) -> DataFrame:
    """(term, n, rows, parts): the postings of a term in some documents, in falling order of the parts."""

    def pack(n: np.ndarray, row: np.ndarray, terms: list[bytes], tf: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // 8 for x in terms])
        term, count = np.frombuffer(b"".join(terms), np.int64), np.frombuffer(b"".join(tf), np.int32).astype(np.int64)
        part = _part(count, np.repeat(_length_norm(n, documents, length), sizes))
        order = np.lexsort((-part, term))
        term, of = term[order], np.repeat(row, sizes)[order]
        each, many = np.unique(term, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(each), pa.array(many), _lists(of, many, np.int64), _lists(part[order], many, np.int32)], names=["term", "n", "rows", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, row, terms, tf, size = [], [], [], [], 0
        for batch in batches:
            n.append(np.asarray(batch.column(0)))
            row.append(np.asarray(batch.column(1)))
            terms += batch.column(2).to_pylist()
            tf += batch.column(3).to_pylist()
            size += sum(len(x) for x in batch.column(2).to_pylist()) // 8
            if size > postings:
                yield pack(np.concatenate(n), np.concatenate(row), terms, tf)
                n, row, terms, tf, size = [], [], [], [], 0
        if size:
            yield pack(np.concatenate(n), np.concatenate(row), terms, tf)

    return docs.select("n", "row", "terms", "tf").mapInArrow(run, "term long, n long, rows binary, parts binary")


def merged(lots: DataFrame) -> DataFrame:
    """(term, rows, parts): the packs of each (term, lot) as one list in falling order of the parts."""

    def merge(term: int, held: list[tuple[bytes, bytes]]) -> tuple[int, bytes, bytes]:
        rows, parts = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), (np.int64, np.int32), strict=True))
        order = np.argsort(-parts, kind="stable")
        return term, rows[order].tobytes(), parts[order].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["term", "rows", "parts"])

        now, held = None, []
        for batch in byte_slices(batches, 2, 1 << 22, 5000):
            out = []
            for term, lot, rows, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (term, lot) != now:
                    out.append(merge(now[0], held))
                    held = []
                now = (term, lot)
                held.append((rows, parts))
            yield batch_of(out)
        yield batch_of([merge(now[0], held)] if held else [])

    rows = lots.select("term", "lot", "rows", "parts").repartition("term", "lot").sortWithinPartitions("term", "lot")
    return rows.mapInArrow(run, "term long, rows binary, parts binary")


def heads(lists: DataFrame, top: int) -> DataFrame:
    """(term, row, part) of the first `top` entries of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x[: 8 * top], np.int64) for x in batch.column(1).to_pylist()]
            parts = b"".join(x[: 4 * top] for x in batch.column(2).to_pylist())
            terms = np.repeat(np.asarray(batch.column(0)), [len(x) for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.concatenate(rows) if rows else terms), pa.array(np.frombuffer(parts, np.int32).astype(np.int64))], names=["term", "row", "part"])

    first = Window.partitionBy("term").orderBy(F.desc("part"), "row")
    return lists.mapInArrow(run, "term long, row long, part long").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= top).drop("__n")


def fetched(lists: DataFrame, shares: int) -> DataFrame:
    """(share, term, rows, parts): the entries of lists (term, rows, parts, least) with parts from `least` on, by share of the documents, in falling order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, 1 << 22, 1000):
            out: list[list] = [[], [], [], []]
            for term, rows, parts, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = np.frombuffer(parts, np.int32)
                parts = parts[: int(np.searchsorted(-parts, -least, "right"))]
                if not len(parts):  # the whole list is under the threshold
                    continue
                rows = np.frombuffer(rows, np.int64)[: len(parts)]
                share = (mixed(rows.view(np.uint64), 0x9FB21C651E98DF25) % np.uint64(shares)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                each, at = np.unique(share[order], return_index=True)
                for k, i, j in zip(each.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
                    for column, x in zip(out, (k, term, rows[order[i:j]].tobytes(), parts[order[i:j]].tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["share", "term", "rows", "parts"])

    return lists.select("term", "rows", "parts", "least").mapInArrow(run, "share long, term long, rows binary, parts binary")


def summed(pieces: DataFrame, top: int) -> DataFrame:
    """(item, row, got, upper): what fetched entries give documents of a share and what these may have at most, but for documents that
    stay under an item's bound, or under the top-th sum of the share.

    pieces: (share, group, rows, parts, weight, might, asked), asked: array of (item, total, bound) of the items of a group that have the term.
    """

    def share_of(held: list[tuple]) -> Iterator[tuple]:
        every = np.unique(np.concatenate([rows for rows, *_ in held]))
        wanted: dict[tuple, list[tuple]] = {}
        for rows, gives, might, asked in held:
            piece = (np.searchsorted(every, rows), gives, might)
            for a in asked:
                wanted.setdefault((a["item"], a["total"], a["bound"]), []).append(piece)
        for (item, total, bound), found in wanted.items():
            at, size = np.concatenate([x for x, _, _ in found]), [len(x) for x, _, _ in found]
            got = np.bincount(at, np.concatenate([x for _, x, _ in found]), len(every)).astype(np.int64)
            known = np.bincount(at, np.repeat([x for _, _, x in found], size), len(every)).astype(np.int64)
            least = max(bound, int(np.partition(got, -top)[-top]) if len(got) >= top else 0)
            left = np.flatnonzero((got + total - known >= least) & (got > 0))
            yield np.full(len(left), item), every[left], got[left], (got + total - known)[left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["item", "row", "got", "upper"])

        now, held = None, []
        for batch in byte_slices(batches, 2, 1 << 22, 1000):
            for share, group, rows, parts, weight, might, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (share, group) != now:
                    yield batch_of(list(share_of(held)))
                    held = []
                now = (share, group)
                held.append((np.frombuffer(rows, np.int64), np.frombuffer(parts, np.int32) * np.int64(weight), might, asked))
        yield batch_of(list(share_of(held)) if held else [])

    rows = pieces.select("share", "group", "rows", "parts", "weight", "might", "asked").repartition("share", "group").sortWithinPartitions("share", "group")
    return rows.mapInArrow(run, "item long, row long, got long, upper long")


def looked_up(rows: DataFrame, documents: int, length: int, id_kind: str) -> DataFrame:
    """(item, id, row, score) of rows (item, id, row, n, terms, tf, asked, weights): terms that item and document share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for n, terms, tf, asked, weights in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                _, a, b = np.intersect1d(np.frombuffer(terms, np.int64), np.array(asked, np.int64), assume_unique=True, return_indices=True)
                part = _part(np.frombuffer(tf, np.int32)[a].astype(np.int64), _length_norm(np.array([n]), documents, length))
                score.append(int((part * np.array(weights, np.int64)[b]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.int64())], names=["item", "id", "row", "score"])

    return rows.select("item", "id", "row", "n", "terms", "tf", "asked", "weights").mapInArrow(run, f"item long, id {id_kind}, row long, score long")


def _kth(sums: DataFrame, column: str, top: int) -> DataFrame:
    """(item, bound): the top-th largest value of each item, 0 where it has fewer."""
    first = Window.partitionBy("item").orderBy(F.desc(column))
    best = sums.select("item", column).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= top)
    return best.groupBy("item").agg(F.coalesce(F.max(F.when(F.col("__n") == top, F.col(column))), F.lit(0)).alias("bound"))


def bounded(small: DataFrame) -> DataFrame:
    """A table that is broadcast if it has few rows."""
    return F.broadcast(small) if small.count() <= MOST_ROWS else small


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", entries: int = 100_000, share: int = 10_000) -> DataFrame:
    """item, rank (from 1), id and score of the `top` best documents of each item, as far as their score is above 0.

    entries: postings of a list; share: documents whose sums a task has at once.
    """
    asked = checkpointed(occurrences(items, item_col, item_text_col))
    pairs = checkpointed(item_terms(asked))
    terms = checkpointed(pairs.select("term").distinct())
    only = np.sort(np.array([r.term for r in terms.collect()], np.int64).view(np.uint64)) if terms.count() <= MOST_TERMS else None
    every = checkpointed(occurrences(docs, id_col, text_col, only))
    documents, length = every.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    postings = packs(every, documents, length)
    if only is None:
        postings = postings.join(terms, "term", "left_semi")
    df = postings.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    known = checkpointed(df.select("term", weight.alias("weight"), F.ceil(F.col("df") / entries).cast("int").alias("lots")).where("weight > 0"))
    lots = postings.join(bounded(known), "term").withColumn("lot", F.pmod(F.xxhash64("rows"), F.col("lots")).cast("int"))
    lists = checkpointed(merged(lots))

    # 1: heads
    pairs = checkpointed(pairs.join(bounded(known.select("term", "weight")), "term"))
    head = checkpointed(heads(lists, top).join(bounded(known.select("term", "weight")), "term").select("term", "row", (F.col("part") * F.col("weight")).alias("got")))
    sums = pairs.select("item", "term").join(head, "term").groupBy("item", "row").agg(F.sum("got").alias("got"))
    lower = _kth(sums, "got", top)

    # 2: the threshold, of lists in rising order of their heads
    most = head.groupBy("term").agg(F.max("got").alias("most"))
    by_item = Window.partitionBy("item").orderBy("most", "term")
    before, of_item = by_item.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("item")
    levels = pairs.join(bounded(checkpointed(most)), "term").join(lower, "item")
    levels = levels.withColumn("__sum", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("__left", F.count(F.lit(1)).over(of_item) - F.row_number().over(by_item) + 1)
    # a document that has `level` at most in all lists stays under the bound
    over = F.col("__sum") + F.col("__left") * F.col("most") > F.col("bound") - 1
    level = F.min_by(F.when(over, F.expr("(bound - 1 - __sum) div __left")), F.when(over, F.struct("most", "term"))).over(of_item)
    levels = checkpointed(levels.select("item", "term", "weight", "most", "bound", F.greatest(level, F.lit(0)).alias("level")))
    # a list is fetched once, as far as any of its items asks, and then serves all of them
    of_term = levels.groupBy("term", "weight", "most").agg(F.min("level").alias("level"))
    of_term = checkpointed(of_term.select("term", F.expr("level div weight + 1").alias("least"), F.least(F.expr("level div weight * weight"), "most").alias("might")))
    asks = levels.select("item", "term", "weight", "bound").join(bounded(of_term.drop("least")), "term")
    asks = asks.select("*", F.sum("might").over(of_item).alias("total"))
    group = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-asked.count() // MOST_ITEMS))))
    asks = checkpointed(asks.groupBy("term", "weight", "might", group.alias("group")).agg(F.collect_list(F.struct("item", "total", "bound")).alias("asked")))
    pieces = fetched(lists.join(bounded(of_term.select("term", "least")), "term"), max(1, documents // share))
    sums = checkpointed(summed(pieces.join(bounded(asks), "term"), top))
    left = checkpointed(sums.join(bounded(checkpointed(_kth(sums, "got", top))), "item").where("upper >= bound").select("item", "row"))

    # 3: exact scores of those left; a document's occurrences are shuffled once for many items
    parts = parts_for(left.count())
    found = marked(every, F.xxhash64("row"), checkpointed(bitmap_of(left, F.xxhash64("row"), parts)), "__in", parts).where("__in").drop("__in")
    vectors = checkpointed(pairs.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("v")).select("item", F.col("v.term").alias("asked"), F.col("v.weight").alias("weights")))
    by_row = left.groupBy("row", group.alias("group")).agg(F.collect_list("item").alias("items"))
    rows = by_row.join(found, "row").withColumn("item", F.explode("items")).drop("items").join(bounded(vectors), "item")
    scores = looked_up(rows, documents, length, docs.schema[id_col].dataType.simpleString()).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    names = checkpointed(asked.select(F.col("id").alias("__id"), F.col("row").alias("__item")))
    return ranked.join(bounded(names), F.col("item") == F.col("__item")).select(F.col("__id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
