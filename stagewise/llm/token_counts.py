"""Token counts, exact for texts of any length.

Texts of more than two chunks are encoded by the tokenizer library in overlapping chunks, with the byte offset of every
token, and spliced where the encodings of two neighbouring chunks both begin a
pre-token at the same byte. Such a boundary is stable: the pre-tokenizer looks
only ahead, so from there on the right chunk's encoding is that of the whole
text; and the left chunk's is right up to there, since the boundary keeps a
guard distance from the chunk's end, more than any lookahead or special string.
Without a common boundary the overlap doubles, in the end to the whole chunk.

Texts of up to two chunks have nothing to splice. They are cut at sure
boundaries (presplit); the library encodes each distinct part once and the
counts are added. Other byte-level or word-level files are encoded whole.

In SentencePiece models whose pieces have no blank but at their beginning, no
piece spans a blank after another character, so that boundary is proven beforehand: their texts
are cut there into chunks, where the blank between is the one that the model
sets before every text. Other models encode whole texts.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings inside texts become their special token, the library's default; an
empty table gives no rows. Rows are handled one by one, so ties, repeats and
extra columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stagewise.llm import presplit
from stagewise.llm.common import byte_slices, ship, text_of

#: Parts of a generation that a worker remembers.
PARTS = 200_000
#: Where a piece of a SentencePiece model begins: at a blank between other characters.
PIECE_START = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")


class TokenCounter:
    def __init__(self, path: str, chunk: int = 4096, overlap: int = 128) -> None:
        self.path, self.chunk, self.overlap = path, chunk, overlap
        self.parts = presplit.Generations(PARTS)
        self.spliced = self.widened = 0
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            spelled = (self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size()))
            probe = ["a", "bc", "d1", "é!", "日"]
            sure = not any(re.search("[^\u2581]\u2581", x) for x in spelled)
            self.sure = sure and self.pieces.encode(" ".join(probe)) == sum(self.pieces.encode(probe), [])
        else:
            from tokenizers import Tokenizer

            self.pieces = None
            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.guard = 8 + max([4, *(len(s.encode()) for s in self.special)])
            self.byte_level = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None
            if self.byte_level:  # a token has a letter for each byte
                vocabulary = self.library.get_vocab()
                self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
                for t, i in vocabulary.items():
                    self.n_bytes[i] = len(t.encode()) if t in self.special else len(t)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; no text is null."""
        if self.pieces is not None:
            return self.count_pieces(texts.to_pylist())
        if not self.byte_level:
            return np.array([len(e.ids) for e in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)], np.int64)
        found = np.zeros(len(texts), np.int64)
        huge = np.asarray(pc.utf8_length(texts)) > 2 * self.chunk
        for i in np.flatnonzero(huge):
            found[i] = len(self.encode_huge(texts[i].as_py()))
        parts, codes, counts = presplit.coded(texts.filter(pa.array(~huge)), self.special)
        missing = self.parts.missing([x for x in parts if isinstance(x, str)])
        for x, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            self.parts[x] = len(e.ids)
        sizes = np.fromiter((self.parts[x] if isinstance(x, str) else 1 for x in parts), np.int64, len(parts))
        found[~huge] = np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(counts)])])
        return found

    def count_pieces(self, texts: list[str]) -> np.ndarray:
        chunks: list[str] = []
        of: list[int] = []
        for i, text in enumerate(texts):
            begin = 0
            while self.sure and len(text) - begin > 2 * self.chunk and (m := PIECE_START.search(text, begin + self.chunk)):
                chunks.append(text[begin : m.start()])
                of.append(i)
                begin = m.end()
            self.spliced += begin > 0
            chunks.append(text[begin:])
            of.append(i)
        return np.bincount(of, [len(x) for x in self.pieces.encode(chunks, num_threads=1)], len(texts)).astype(np.int64) if texts else np.empty(0, np.int64)

    def encoded(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, first bytes (at: that of the text) and whether a pre-token starts there."""
        e = self.library.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.int64)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        starts = at + np.cumsum(self.n_bytes[ids]) - self.n_bytes[ids]
        new = np.ones(len(ids), bool)
        new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        return ids, starts, new

    def encode_huge(self, text: str) -> list[int]:
        self.spliced += 1
        out: list[int] = []
        begin, end = 0, min(len(text), self.chunk)
        at, end_byte = 0, len(text[:end].encode())
        ids, starts, word = self.encoded(text[:end], 0)
        while end < len(text):
            overlap, nxt = self.overlap, min(len(text), end + self.chunk)
            while True:
                a = max(begin, end - overlap)
                a_byte = end_byte - len(text[a:end].encode())
                right = self.encoded(text[a:nxt], a_byte)
                stable = starts[word & (starts <= end_byte - self.guard)]
                common = np.intersect1d(stable, right[1][right[2]])
                if len(common):
                    p = common[-1]
                    out += ids[starts < p].tolist()
                    keep = right[1] >= p
                    ids, starts, word = (x[keep] for x in right)
                    # text from byte p on is what the next splice may widen over
                    begin = end - len(text.encode()[p:end_byte].decode(errors="ignore")) if p < end_byte else end
                    at = int(p)
                    break
                self.widened += 1
                if a == begin:  # the chunk has no boundary: take both as one
                    ids, starts, word = self.encoded(text[begin:nxt], at)
                    break
                overlap *= 2
            end_byte += len(text[end:nxt].encode())
            end = nxt
        return out + ids.tolist()


_counters: dict[tuple, TokenCounter] = {}


def _counter(*key) -> TokenCounter:
    """One for each worker process, over all its tasks."""
    if key not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[key] = TokenCounter(*key)
    return _counters[key]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 4096) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit of every row; tokenizer: path of a .json or .model file, there on every machine."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, chunk)
        for rows in byte_slices(batches, 1, most_bytes=4 << 20, most_rows=1000):
            n = counter.count(rows.column(1))
            yield pa.RecordBatch.from_arrays([rows.column(0), pc.binary_length(rows.column(1)).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
