"""Substring deduplication: passages that started earlier in the corpus go.

A window is `window` consecutive words. A word goes if a window that covers it
has the words of a window that starts earlier.

The reference of a corpus cleaned of its own repeats is the corpus, so suffix
automata of all of it can't be broadcast: their size grows with the input, and
every document would have to pass every shard. Instead, the reference is first
cut to the passages that can match, and these meet the passages that can match
them in shards of bounded size:

1. Anchors. Each window is named by the least hash among its runs of `gram`
   words. Equal windows have equal anchors. Windows that share an anchor's
   place in a document form a fragment. Anchors that occur once in the corpus
   leave; a bitmap of bounded size spares most of them the shuffle.
2. Classes. Equal fragments of an anchor are one class, with its first place;
   the others in the class go whole. Counting has map-side combining, joins are
   over hashed keys that adaptive execution can split.
3. Automata. Where an anchor has several classes, the classes' first
   occurrences stream, in corpus order, over a suffix automaton of the
   fragments before them: where the matching statistic reaches `window` words,
   a window started earlier. A shard is the anchors of a hash value, its
   automata hold one anchor each.
4. Anchors with more than `most` classes (a frequent line in ever different
   surroundings) are split further: their windows are grouped by hash, which is
   exact as well and has map-side combining.

Words and runs are compared by 64-bit hashes, windows of case 4 by 64-bit
hashes of their words.

Documents go by id and `tie`, which tells rows of one id apart by the hash of
their texts and is 0 where no id has two texts.

Defined results: a null text has no words; texts of fewer words than a window
stay whole; a null id counts as the least; rows repeating an id and a text are
one document and get equal results; of one id's different texts, the one with
the lesser hash comes first; an empty table gives no rows; input
columns play no part but id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import bitmap_of, byte_slices, checkpointed, marked, parts_for, ship, text_of
from stagewise.llm.near_dedup import _batch, _groups, _with_last
from stagewise.llm.words import FACTORS, U64, hashed_words, mixed

BASE = U64(0x9E3779B97F4A7C15)
UNBASE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: A place in a document: start << 16 | windows << 8 | words before the anchor.
NO_ID = -(2**63)


class SuffixAutomaton:
    """Of any number of sequences, over arbitrary symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, sequence: list) -> Iterator[int]:
        """At each place, the length of the longest run up to it that some sequence has."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            else:
                n = 0
            yield n


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    total = np.zeros(n, U64)
    for j in range(k):
        total += h[j : j + n] * FACTORS[j]
    return mixed(total, 0xC2B2AE3D27D4EB4F)


def fragments(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, hash, first window, windows and words before the anchor of each fragment of hashed words h, at least a window of them."""
    g = _grams(h, gram)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(1)
    at += np.arange(len(at))
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(start, len(at)))
    power = np.full(len(h), BASE, U64)
    back = np.full(len(h), UNBASE, U64)
    power[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * np.multiply.accumulate(power), dtype=U64)])
    body = (sums[start + count + window - 1] - sums[start]) * np.multiply.accumulate(back)[start]
    before = at[start] - start
    place = (count * 256 + before).astype(U64)
    return g[at[start]], mixed(body + place * FACTORS[11], 0x9FB21C651E98DF25), start, count, before


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def anchor_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, n), counted within batches already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            held = [fragments(h, window, gram)[0] for h in hashed_words(batch.column(1)) if len(h) >= window]
            a, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, U64), np.empty(0, np.int64))
            yield _batch(["anchor", "n"], _signed(a), pa.array(n.astype(np.int64)))

    return docs.select("id", "text").mapInArrow(run, "anchor long, n long")


def placed_fragments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, frag, id, tie, at) of every fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2):
            held = [(k, *fragments(h, window, gram)) for k, h in enumerate(hashed_words(batch.column(2))) if len(h) >= window]
            if held:
                at = [(start << 16) | (count << 8) | before for _, _, _, start, count, before in held]
                row = pa.array(np.repeat([x[0] for x in held], [len(x) for x in at]))
                yield _batch(["anchor", "frag", "id", "tie", "at"], _signed(np.concatenate([x[1] for x in held])), _signed(np.concatenate([x[2] for x in held])), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(at).astype(np.int64)))

    return docs.select("id", "tie", "text").mapInArrow(run, "anchor long, frag long, id long, tie long, at long")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(sizes, values) of lists; a null is empty."""
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0)), column.flatten()


def with_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted (anchor, hot, id, tie, at) with the hashed words of each fragment."""
    parts = parts_for(wanted.count())
    texts = marked(docs, F.xxhash64("id"), checkpointed(bitmap_of(wanted, F.xxhash64("id"), parts)), "__held", parts).where("__held").select("id", "tie", "text")
    lists = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("anchor", "hot", "at")).alias("list"))  # no more than a document's words
    rows = texts.join(lists.select(F.col("id").alias("__i"), F.col("tie").alias("__t"), "list"), (F.col("id") == F.col("__i")) & (F.col("tie") == F.col("__t"))).select("id", "tie", "text", "list")
    names = ["anchor", "hot", "id", "tie", "at", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2, most_bytes=1 << 20):
            sizes, places = _lists(batch.column(3))
            at = np.asarray(places.field("at"))
            done = 0
            for k, h in enumerate(hashed_words(batch.column(2))):
                for i in range(done, done + sizes[k], 2000):  # a long document's fragments in parts
                    mine = slice(i, min(i + 2000, done + sizes[k]))
                    start, stop = at[mine] >> 16, (at[mine] >> 16) + ((at[mine] >> 8) & 255) + window - 1
                    words = pa.array([h[x:y].tobytes() for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())
                    part, n = places.slice(mine.start, mine.stop - mine.start), len(words)
                    yield pa.RecordBatch.from_arrays([part.field("anchor"), part.field("hot"), pa.repeat(batch.column(0)[k], n), pa.repeat(batch.column(1)[k], n), part.field("at"), words], names=names)
                done += sizes[k]

    return rows.mapInArrow(run, "anchor long, hot boolean, id long, tie long, at long, words binary")


def streamed(rows: DataFrame, window: int) -> DataFrame:
    """(id, tie, a, b): words a to b of documents that the anchors' automata find repeated; rows: (anchor, id, tie, at, words)."""

    def spans(part: pa.Table) -> Iterator[tuple[int, int, int, int]]:
        automaton = SuffixAutomaton()
        ids, ties, places, words = (part.column(c).to_pylist() for c in ("id", "tie", "at", "words"))
        before = None
        for i, tie, at, w in zip(ids, ties, places, words, strict=True):
            if (i, tie, at) == before:  # rows that repeat an id and a text count once
                continue
            before = (i, tie, at)
            sequence = np.frombuffer(w, np.uint64).tolist()
            a, b = -1, -1
            for k, n in enumerate(automaton.matches(sequence)):
                if n >= window:
                    if k - window + 1 > b:
                        if b > a:
                            yield i, tie, (at >> 16) + a, (at >> 16) + b
                        a = k - window + 1
                    b = k + 1
            if b > a:
                yield i, tie, (at >> 16) + a, (at >> 16) + b
            automaton.add(sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch, last in _with_last(batches):
            t = pa.Table.from_batches([*held, batch])
            anchor = np.array(t.column("anchor").to_pylist(), np.int64)
            out: list[tuple[int, int, int, int]] = []
            done = 0
            for i, j in _groups(anchor):
                if j < len(anchor) or last:
                    out += spans(t.slice(i, j - i))
                    done = j
            held = t.slice(done).to_batches()
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield _batch(["id", "tie", "a", "b"], *[pa.array(c, pa.int64()) for c in cols])

    return rows.select("anchor", "id", "tie", "at", "words").repartition("anchor").sortWithinPartitions("anchor", "id", "tie", "at").mapInArrow(run, "id long, tie long, a long, b long")


def split_windows(rows: DataFrame, window: int) -> DataFrame:
    """(id, tie, a, b): the same for rows of anchors with many classes, by the hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 3, most_bytes=1 << 20):
            keys = [_grams(np.frombuffer(w, np.uint64), window) for w in batch.column(3).to_pylist()]
            n = np.array([len(k) for k in keys])
            row = pa.array(np.repeat(np.arange(len(n)), n))
            start = np.repeat((np.asarray(batch.column(2)) >> 16) - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield _batch(["key", "id", "tie", "a"], _signed(np.concatenate(keys)), batch.column(0).take(row), batch.column(1).take(row), pa.array(start))

    windows = checkpointed(rows.select("id", "tie", "at", "words").mapInArrow(run, "key long, id long, tie long, a long"))
    first = windows.groupBy("key").agg(F.min(F.struct("id", "tie", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("key").alias("__key"), F.xxhash64("key").alias("__k"), "first")
    later = windows.join(first, (F.xxhash64("key") == F.col("__k")) & (F.col("key") == F.col("__key"))).where(F.struct("id", "tie", "a") != F.col("first"))
    return later.select("id", "tie", "a", (F.col("a") + window).alias("b"))


def repeated_spans(docs: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """(id, tie, a, b): words a to b of each document (id, tie, text) that are repeats."""
    counts = checkpointed(anchor_counts(docs, window, gram).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    parts = parts_for(counts.count())
    bitmap = checkpointed(bitmap_of(counts, F.xxhash64("anchor"), parts))
    rows = marked(placed_fragments(docs, window, gram), F.xxhash64("anchor"), bitmap, "__held", parts).where("__held").drop("__held")
    rows = checkpointed(rows.join(counts.select(F.col("anchor").alias("__a")), F.col("anchor") == F.col("__a")).drop("__a"))

    place = F.struct("id", "tie", "at")
    classes = checkpointed(rows.groupBy("anchor", "frag").agg(F.min(place).alias("first")))
    key = F.xxhash64("anchor", "frag")
    later = rows.join(classes.select(F.col("anchor").alias("__a"), F.col("frag").alias("__f"), "first", key.alias("__k")), (key == F.col("__k")) & (F.col("anchor") == F.col("__a")) & (F.col("frag") == F.col("__f")))
    later = later.where(place != F.col("first"))
    start, count = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255))
    whole = later.select("id", "tie", start.alias("a"), (start + count + window - 1).alias("b"))

    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("anchor").alias("__a"), F.xxhash64("anchor").alias("__k"), (F.col("__n") > most).alias("hot"))
    wanted = classes.join(several, (F.xxhash64("anchor") == F.col("__k")) & (F.col("anchor") == F.col("__a"))).select("anchor", "hot", F.col("first.id").alias("id"), F.col("first.tie").alias("tie"), F.col("first.at").alias("at"))
    pieces = checkpointed(with_words(docs, checkpointed(wanted), window))
    return whole.unionByName(streamed(pieces.where("not hot"), window)).unionByName(split_windows(pieces.where("hot"), window))


def clean_texts(docs: DataFrame, digest: bool, window: int, gram: int, most: int) -> DataFrame:
    """id, n_words, n_removed and kept (the words that stay, joined by spaces, or with digest their SHA-256) of docs (id, text)."""
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    tie = F.xxhash64(text_of("text"))
    shared = docs.groupBy("id").agg(F.min(tie).alias("low"), F.max(tie).alias("high")).where("low != high").isEmpty()
    docs = docs.select("id", (F.lit(0).cast("long") if shared else tie).alias("tie"), "text")
    # a span as one number; spans of a document are no more than its words
    packed = (F.shiftleft("a", 32) + F.col("b")).alias("span")
    spans = checkpointed(repeated_spans(docs, window, gram, most).select("id", "tie", packed).groupBy("id", "tie").agg(F.collect_set("span").alias("spans")))
    parts = parts_for(spans.count())
    rows = marked(docs, F.xxhash64("id"), checkpointed(bitmap_of(spans, F.xxhash64("id"), parts)), "__held", parts)
    clean = rows.where(~F.col("__held")).select("id", "text", F.lit(None).cast("array<long>").alias("spans"))
    held = rows.where("__held").join(spans.select(F.col("id").alias("__i"), F.col("tie").alias("__t"), "spans"), (F.col("id") == F.col("__i")) & (F.col("tie") == F.col("__t")), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, most_bytes=1 << 20):
            n, removed, kept, ids = [], [], [], []
            sizes, values = _lists(batch.column(2))
            flat, done = np.asarray(values), 0
            for k, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                if sizes[k]:
                    mine = flat[done : done + sizes[k]]
                    edge = np.bincount(mine >> 32, minlength=len(words) + 1) - np.bincount(mine & 0xFFFFFFFF, minlength=len(words) + 1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    done += sizes[k]
                removed.append(n[-1] - len(words))
                joined = b" ".join(words)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
                ids.append(None if i == NO_ID else i)
            yield _batch(["id", "n_words", "n_removed", "kept"], pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()))

    return clean.unionByName(held).mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 6, most: int = 1000, digest: bool = False) -> DataFrame:
    """id, n_words, n_removed and the text that stays (kept_text, or with digest kept_sha256) of every row; window: at most 255 words, gram: at most window."""
    if not 0 < gram <= window <= 255:
        raise ValueError("0 < gram <= window <= 255 is needed: places hold counts in a byte")
    out = clean_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), digest, window, gram, most)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "kept_text"))
