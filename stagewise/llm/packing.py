"""Best-fit packing of token sequences, planned on the histogram of lengths.

Every text becomes its ids and an end id. Texts of more than `limit` ids are cut
into pieces of `limit`; what is left over is the first piece. All that best fit
decreasing looks at is how many pieces have each length, so it is planned on that
histogram, which has `limit` rows at most whatever the input: lengths go from the
longest to the shortest, each length goes to the fullest sequences where it
still fits, as many at once as there are, and to new sequences when none is
left. The plan is a list of slots: so many pieces of a length, from a rank on, go
to consecutive sequences at one offset.

Pieces know their rank within their length by counting: each task numbers its own
pieces of each length, the counts of (task, length) are summed up in order, and a
piece's rank is the sum before its task and its own number. A piece then takes
the slot whose ranks hold its rank. No text is shuffled, no group is gathered,
and a length that a third of all pieces share is no hot group anywhere.

Ids are those of the tokenizers library. Plain texts are encoded by tiktoken from
the same vocabulary, if the file is byte-level BPE whose merges are its ranks;
texts with other characters than those that all versions of Unicode class
alike, with special strings or with very long words go through the library itself.

Defined results: a null text counts as empty and is its end id; equal rows are packed
one by one; rows that repeat an id, or have none, are packed like others; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.bpe import byte_letters
from stagewise.llm.common import byte_slices, checkpointed, ship, text_of
from stagewise.llm.presplit import PATTERN

#: Texts for the library: a character outside these, or a run that merges slowly.
ODD = re.compile("[^\t-\r -~ -ɏ‐-‧‰-⁞€]|\\S{2000}|\\s{2000}")
#: Rows of (task, length) that are broadcast; more are joined.
MOST_COUNTS = 200_000
BITS = 40


class Ids:
    """Ids of texts as the tokenizers library gives them for a file, without added special tokens."""

    def __init__(self, path: str) -> None:
        self.path, self._library, self.quick = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain = plain and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][x + y] for x, y in merges]
        if plain and ids == sorted(set(ids)):
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[x] for x in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.quick = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def library(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if self.quick is None or ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.library(text), np.uint32)
        return self.quick.encode_to_numpy(text, disallowed_special=())


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One for each worker process."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first one takes what is left over."""
    first = n % limit or limit
    return [(0, first), *((k, limit) for k in range(first, n, limit))]


def pieces(docs: DataFrame, tokenizer: str, limit: int, end: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """id, piece, start, length, ids_crc32, task and number (within the task and the length), and ids if asked for."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = ids_of(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        last = np.array([end], "<u4")
        for rows in byte_slices(batches, 1):
            of, out, parts = [], [], []
            for k, text in enumerate(rows.column(1).to_pylist()):
                ids = np.concatenate([encode(text).astype("<u4", copy=False), last])
                for piece, (start, n) in enumerate(cut(len(ids), limit)):
                    mine = ids[start : start + n]
                    of.append(k)
                    out.append((piece, start, n, zlib.crc32(mine), task, seen[n]))
                    seen[n] += 1
                    if with_ids:
                        parts.append(mine)
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)]
            extra = [pa.array(parts, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of)), *columns, *extra], names=["id", "piece", "start", "length", "ids_crc32", "task", "number", *(["ids"] * with_ids)])

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank, each, sequence, offset) by length and rank: pieces of a length from that rank on go to sequences from
    that one on, `each` to a sequence, the first one of a sequence at the offset.

    Sequences with the same room are intervals (first, how many), so steps grow with lengths, not with pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]

        def fill(first: int, many: int, space: int) -> None:
            """Pieces of this length into sequences with that space, as many as fit, while there are any."""
            nonlocal rank, left
            each = min(space // length, left)
            used = min(many, left // each)
            slots.append((length, rank, each, first, limit - space))
            rank, left = rank + used * each, left - used * each
            room[space - each * length].append((first, used))
            if used < many:
                room[space].append((first + used, many - used))

        space = length
        while left and space <= limit:
            if room[space]:
                fill(*room[space].pop(), space)
            else:
                space += 1
        while left:
            each = min(limit // length, left)
            many = left // each
            fill(sequences, many, limit)
            sequences += many
    return slots


def packed(docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece, and its ids if asked for."""
    every = checkpointed(pieces(docs, tokenizer, limit, end, id_col, text_col, with_ids))
    counts = checkpointed(every.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `limit` rows at most
    slots = np.array(best_fit(histogram, limit), np.int64).reshape(-1, 5)
    slots = slots[np.argsort(slots[:, 0] << BITS | slots[:, 1], kind="stable")]
    key, (_, ranks, each, sequence, offset) = slots[:, 0] << BITS | slots[:, 1], slots.T

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("task").alias("__task"), F.col("length").alias("__length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    counts = checkpointed(counts)
    small = F.broadcast(counts) if counts.count() <= MOST_COUNTS else counts
    ranked = every.join(small, (F.col("task") == F.col("__task")) & (F.col("length") == F.col("__length")))
    ids = ["ids"] * with_ids
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("number")).alias("rank"), *ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, rank = (np.asarray(rows.column(k)) for k in (3, 5))
            slot = np.searchsorted(key, length << BITS | rank, "right") - 1
            more = rank - ranks[slot]
            at, place = sequence[slot] + more // each[slot], offset[slot] + more % each[slot] * length
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(at), pa.array(place), *rows.columns[6:]], names=[id_col, *rows.schema.names[1:5], "sequence_id", "offset", *ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """sequence_id and ids of every packed sequence; a sequence gathers `limit` ids at most."""
    parts = packed(docs, tokenizer, with_ids=True, **options)
    together = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(together, lambda x: x["ids"])).alias("ids"))
