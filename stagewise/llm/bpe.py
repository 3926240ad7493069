"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: its state is the last token, its arcs are labelled
with tokens, and a path is accepted just if it is how BPE writes the bytes that
its labels spell. It is compiled merge by merge. At first every byte may follow
every byte. The gadget of merge k, of (a, b) into c, adds the arc c beside the
path a, b, provided that the automaton so far has that path, and removes the
path: after any token that still shows a at its right edge when merge k comes,
no token may follow that shows b at its left edge then. A token shows, at each
edge, itself and its children along that edge, each from its own merge until
the merge of the parent; at equal ranks the left pair goes first, so the right
token shows the child up to and including its parent's merge.

Compiled, it is flat arrays: the arcs spelled out byte by byte as a trie, the
gadgets sorted by their two tokens, each token's halves and ranks, and a table
of transitions of fixed size that is filled from the gadgets where a cell is
first used. Every prefix of a word has exactly one accepted path. So the words
of a batch are read from left to right, all at once: from the state that a
place has, each label that starts there leads on, if the table has the arc, and
sets the state of the place where it ends. No place is visited twice, and the
path is read back from the word's end. Decoding emits the label of each arc.

Texts are cut where a pre-split boundary is sure, and each distinct part of a
batch of texts is encoded once; a worker keeps the parts of late batches.

Defined results: a null text counts as empty (no tokens, decoded to the empty
text); special strings inside texts become their token; an empty table gives
no rows. Rows are handled one by one, so ties, repeats and extra columns play
no part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stagewise.llm import presplit
from stagewise.llm.common import byte_slices, ship, text_of

#: Parts of a generation that a worker remembers (two generations: about 40 MB), and cells of the table of transitions (9 MB).
PARTS, CELLS = 60_000, 1 << 20
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next free code point from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> None:
        letters = byte_letters()
        spell = lambda token: bytes(letters[x] for x in token)
        self.labels = {i: spell(t) for t, i in vocabulary.items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.special = special
        # a token's merge (-1: a byte), its halves, and the arcs that there are; the last row is the start, which any token may follow
        size = max(self.labels) + 2
        self.start = size - 1
        self.rank = np.full(size, -1, np.int64)
        self.halves = np.full((size, 2), -1, np.int64)
        self.gadgets: dict[int, int] = {}
        arcs: dict[bytes, int] = {self.labels[i]: i for t, i in vocabulary.items() if len(t) == 1 and t in letters}
        has = set(arcs.values())
        for k, (x, y) in enumerate(merges):
            a, b, c = vocabulary[x], vocabulary[y], vocabulary[x + y]
            if a in has and b in has:
                path = self.follows(a, b)
                self.gadgets[a << 32 | b] = k
                if path and c not in has:
                    self.rank[c], self.halves[c] = k, (a, b)
                    arcs[self.labels[c]] = c
                    has.add(c)
        self._compile(arcs)

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(spec["model"]["vocab"], merges, special)

    def follows(self, x: int, y: int) -> bool:
        """Whether the automaton has the arc y from the state x, from the gadgets so far.

        x shows a token at its right edge and y one at its left edge; going back through the merges, the one that was
        merged later gives way to its half.
        """
        rank, halves, gadgets = self.rank, self.halves, self.gadgets
        until_x = until_y = NEVER
        while True:
            since_x, since_y = int(rank[x]), int(rank[y])
            k = gadgets.get(x << 32 | y)
            if k is not None and since_x < k < until_x and since_y < k <= until_y:
                return False
            if since_x < 0 and since_y < 0:
                return True
            if since_x >= since_y:
                until_x, x = since_x, int(halves[x, 1])
            else:
                until_y, y = since_y, int(halves[y, 0])

    def _compile(self, arcs: dict[bytes, int]) -> None:
        """Flat arrays of the gadgets and of the arcs' labels, a trie over bytes."""
        keys = np.array(sorted(self.gadgets), np.int64)
        self.pairs, self.merged = np.append(keys, NEVER << 20), np.array([*(self.gadgets[k] for k in keys.tolist()), -1], np.int64)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for label, token in arcs.items():
            at = 0
            for byte in label:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][byte]
            ends[at] = token
        self._lay_out(children, ends)
        self.cells, self.held = np.full(CELLS, -1, np.int64), np.zeros(CELLS, bool)

    def _lay_out(self, children: list[dict[int, int]], ends: list[int]) -> None:
        """The trie in one row of slots: a node's child by a byte lies at base[node] + byte, where owner is the node; nodes go by their slots."""
        n = len(children) + 70_000
        free = np.ones(n, bool)
        free[:256] = False  # slot 0 is the root's
        base, slot, tail, reach = {}, {0: 0}, 256, 4096
        inner = sorted((k for k, x in enumerate(children) if x), key=lambda k: -len(children[k]))
        for k in inner:
            taken = np.array(sorted(children[k]))
            if len(taken) == 1:
                break
            while True:  # the first place where all are free, near the end of what is filled
                if tail + reach + 256 > len(free):
                    free = np.append(free, np.ones(1 << 16, bool))
                fits = np.logical_and.reduce([free[tail + d : tail + d + reach] for d in (taken - taken[0]).tolist()])
                at = int(fits.argmax())
                if fits[at]:
                    break
                tail += reach
            base[k] = tail + at - int(taken[0])
            free[base[k] + taken] = False
            tail += max(0, at - reach // 2)
        single = [k for k in inner if len(children[k]) == 1]
        for k, at in zip(single, np.flatnonzero(free).tolist(), strict=False):
            base[k] = at - next(iter(children[k]))
        for k in inner:
            for b, child in children[k].items():
                slot[child] = base[k] + b
        size = max(slot.values()) + 512
        self.base, self.owner, self.ends = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for node, at in slot.items():
            self.ends[at] = ends[node]
            if node in base:
                self.base[at] = base[node]
                self.owner[[base[node] + b for b in children[node]]] = at

    def _arcs_between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """follows() of arrays, from the gadgets."""
        out = np.ones(len(x), bool)
        at = np.arange(len(x))
        until_x = until_y = np.full(len(x), NEVER)
        while len(at):
            since_x, since_y = self.rank[x], self.rank[y]
            key = x << 32 | y
            found = np.searchsorted(self.pairs, key)
            k = np.where(self.pairs[found] == key, self.merged[found], -1)
            gone = (since_x < k) & (k < until_x) & (since_y < k) & (k <= until_y)
            out[at[gone]] = False
            on = ~gone & ((since_x >= 0) | (since_y >= 0))
            left = since_x >= since_y
            until_x, until_y = np.where(left, since_x, until_x)[on], np.where(left, until_y, since_y)[on]
            x, y, at = np.where(left, self.halves[x, 1], x)[on], np.where(left, y, self.halves[y, 0])[on], at[on]
        return out

    def transitions(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether there is an arc y from x, for arrays of states and labels, by the table."""
        cell = x << 32 | y
        place = (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (CELLS - 1)
        new = np.flatnonzero(self.cells[place] != cell)
        out = self.held[place]
        if len(new):
            out[new] = self._arcs_between(x[new], y[new])
            # cells that share a place: the last one stays, as key and as value
            self.cells[place[new]] = cell[new]
            self.held[place[new]] = out[new]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the tokens of all words one after the other, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        last = np.cumsum(sizes)
        first = last - sizes
        stop = np.repeat(last, sizes)
        # every label at every place; places after a word's end belong to the next word
        place, node, depth = np.arange(n), np.zeros(n, np.int32), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(place):
            child = self.base[node] + data[place + depth]
            depth += 1
            there = self.owner[child] == node
            place, node = place[there], child[there]
            token = self.ends[node]
            hit = np.flatnonzero(token >= 0)
            found.append((place[hit], place[hit] + depth, token[hit]))
            there = place + depth < stop[place]
            place, node = place[there], node[there]
        begin, end, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        # word position of each place: labels are taken in order of where they begin
        offset = begin - np.repeat(first, sizes)[begin] if n else begin
        order = np.argsort(offset.astype(np.uint16) if n and offset.max() < 65_536 else offset, kind="stable")
        begin, end, token = begin[order], end[order], token[order].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(offset))]).tolist() if n else [0]
        # the place after each byte: its state and where that token begins; before a word, the start
        state, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
            b, e, t = begin[i:j], end[i:j], token[i:j]
            if k:
                ok = self.transitions(state[b], t)
                b, e, t = b[ok], e[ok], t[ok]
            state[e], back[e] = t, b
        # paths, from the words' ends
        live = np.flatnonzero(sizes)
        at, steps = last[live], []
        count = np.zeros(len(words), np.int64)
        while len(live):
            steps.append((live, state[at]))
            count[live] += 1
            at = back[at]
            on = at > first[live]
            live, at = live[on], at[on]
        ids = np.empty(int(count.sum()), np.int32)
        ends = np.cumsum(count)
        for k, (word, t) in enumerate(steps):
            ids[ends[word] - 1 - k] = t
        return ids, count

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode(errors="replace")


class Coder:
    """Whole texts to ids and back, in batches."""

    def __init__(self, path: str) -> None:
        self.automaton = Automaton.load(path)
        n = self.automaton.start
        labels = [self.automaton.labels.get(i, b"") for i in range(n)]
        self.labels, self.label_sizes = b"".join(labels), np.array([len(x) for x in labels])
        self.label_array = pa.array(labels, pa.binary())
        self.decimals = pa.array([b"%d," % i for i in range(n)], pa.binary())
        self.parts = presplit.Generations(PARTS)

    def _encode_parts(self, parts: list[str]) -> None:
        """Remember the ids of parts."""
        words: list[bytes] = []
        per: list[int] = []
        for part in parts:
            bare = part[1:]
            if bare.isascii() and bare.isalpha() and part[0] == " ":  # blank and letters: one word
                words.append(part.encode())
                per.append(1)
            else:
                pieces = presplit.PIECES.findall(part)
                words += [x.encode() for x in pieces]
                per.append(len(pieces))
        ids, lengths = self.automaton.encode_words(words)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per)]).astype(np.int64)] * 4
        data = ids.tobytes()
        self.parts.update(zip(parts, map(data.__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist())), strict=True))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of all texts one after the other; no text is null."""
        parts, codes, counts = presplit.coded(texts, self.automaton.special)
        size, block = 0, []
        for x in self.parts.missing([x for x in parts if isinstance(x, str)]):
            block.append(x)
            size += len(x)
            if size > 200_000:
                self._encode_parts(block)
                size, block = 0, []
        if block:
            self._encode_parts(block)
        values = [self.parts[x] if isinstance(x, str) else np.int32(x).tobytes() for x in parts]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        store = np.frombuffer(b"".join(values), np.int32)
        begin = np.cumsum(sizes) - sizes
        # the ids of each occurrence of a part
        size = sizes[codes]
        to = np.cumsum(size)
        ids = store[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begin[codes] - (to - size), size)]
        ends = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text]))[0].tolist()

    def written(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        """The ids of each text as decimal numbers joined by commas."""
        yield from (x[:-1] for x in joined(self.decimals.take(pa.array(ids)), lengths))

    def decode_batch(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[str]:
        """The text of each text's ids: the labels of the arcs, one after the other."""
        yield from (x.decode(errors="replace") for x in joined(self.label_array.take(pa.array(ids)), lengths))

    def decode(self, ids: list[int]) -> str:
        return next(self.decode_batch(np.array(ids, np.int32), np.array([len(ids)])))


def joined(values: pa.BinaryArray, lengths: np.ndarray) -> Iterator[bytes]:
    """So many values each, one behind the other: they lie like that already."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32, len(values) + 1)[np.concatenate([[0], np.cumsum(lengths)])].tolist() if len(values) else [0] * (len(lengths) + 1)
    view = memoryview(data) if data is not None else memoryview(b"")
    return (bytes(view[i:j]) for i, j in zip(at, at[1:], strict=False))


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One for each worker process, over all its tasks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (ids as decimal numbers joined by commas) and decoded_sha256 of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for rows in byte_slices(batches, 1):
            ids, n = c.encode_batch(rows.column(1))
            written = pa.array([sha(x) for x in c.written(ids, n)], pa.string())
            decoded = pa.array([sha(x.encode()) for x in c.decode_batch(ids, n)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), written, decoded], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with the ids of the text (array of int) and the text decoded from them; columns of those names are replaced."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in {ids_col.lower(), decoded_col.lower()}]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for rows in byte_slices(batches, at):
            ids, n = c.encode_batch(rows.column(at).fill_null(""))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(list(c.decode_batch(ids, n)), pa.string())], names=[*keep, ids_col, decoded_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep).mapInArrow(run, f"{schema}, `{ids_col}` array<int>, `{decoded_col}` string")
