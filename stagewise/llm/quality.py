"""Document quality by a linear-chain conditional random field over lines.

Each line has features of its characters and words; a line's evidence is a
weighted sum of its own, the previous and the next line's features. The chain
labels every line good (1) or bad (0) with weights for neighbouring labels;
forward and backward sums give each line's probability of good, and their mean,
weighted by line length, is the document's score.

The field is fitted on at most `sample` labelled documents with at most `lines`
lines in all (documented bounds: those with the least hash of their id, as long
as their lines fit), whose lines all carry the document's
label. Only line features of the sample reach the driver. Scoring runs over
batches of whole documents; every step works on all lines of a batch at once.

Defined results: a null text counts as empty, which is one empty line; the lines
of a text are what line feeds divide; without any labelled document, or with one
label only, the score of every document is that label's share, or 0.5; repeated
rows get equal scores; an empty table gives no rows; input columns named like
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import ship, with_result

#: Features of a line by itself.
OWN = ("upper", "symbol", "digit", "punctuation", "repeat", "log_words", "word_length", "empty")
RESULTS = ("score", "predicted")

UPPER, LETTER, DIGIT, PUNCTUATION, SYMBOL, WHITE = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; others count as letters."""
    out = np.full(0x250, LETTER, np.uint8)
    for i in range(0x250):
        c = chr(i)
        if c in " \t\n\x0b\x0c\r":
            out[i] = WHITE
        elif c.isalpha():
            out[i] = LETTER | (UPPER if c.isupper() else 0)
        elif c.isdigit():
            out[i] = DIGIT
        else:
            out[i] = PUNCTUATION if c in ".,;:'\"?()-" else SYMBOL
    return out


CLASSES = _classes()
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, document) of each line of the texts, in order."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    kind = CLASSES[np.minimum(codes, 0x24F)]
    # a line feed ends each line; the one added between texts also ends a text
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    starts = np.append(0, ends[:-1] + 1)
    # text of each line: lines before the end of text i are the line feeds in it and one
    per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), per_text)
    chars = ends - starts

    def inside(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[ends] - total[starts]

    letters, upper, digit, punctuation, symbol = (inside((kind & k) > 0) for k in (LETTER, UPPER, DIGIT, PUNCTUATION, SYMBOL))
    solid = (kind & WHITE) == 0
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # hash of a word: a polynomial of its characters, from prefix sums
    power = np.full(len(codes) + 1, BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * power[1:], dtype=np.uint64)])
    back = np.full(len(codes) + 1, UNBASE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    word = (sums[last] - sums[first]) * back[first]
    line_of = np.searchsorted(ends, first)
    words = np.bincount(line_of, minlength=len(ends))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, again, minlength=len(ends))
    white = inside(~solid)
    ink = np.maximum(chars - white, 1)
    own = np.stack([upper / np.maximum(letters, 1), symbol / ink, digit / ink, punctuation / ink, repeats / np.maximum(words, 1), np.log1p(words) / 4, np.minimum(ink / np.maximum(words, 1), 30) / 10, words == 0], 1).astype(np.float64)
    # the neighbours' features, zero at a document's ends, and whether it has that neighbour
    same = doc[1:] == doc[:-1]
    before, after = np.zeros((len(own), own.shape[1] + 1)), np.zeros((len(own), own.shape[1] + 1))
    before[1:] = np.where(same[:, None], np.column_stack([own[:-1], np.ones(len(own) - 1)]), 0)
    after[:-1] = np.where(same[:, None], np.column_stack([own[1:], np.ones(len(own) - 1)]), 0)
    return np.column_stack([np.ones(len(own)), own, before, after]), chars, doc


def marginals(evidence: np.ndarray, doc: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each pair of neighbouring labels.

    evidence: log odds of good, by line; pairs[y, z]: weight of label y before z. The forward and backward
    sums are kept as shares of good, so nothing overflows. All documents step forward and back together.
    """
    n = int(doc[-1]) + 1
    size = np.bincount(doc, minlength=n)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    order = np.argsort(-size, kind="stable")  # those that are still running come first
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])) - 0.5)  # documents with more than k lines
    odds = np.exp(np.clip(evidence, -40, 40))
    p = np.exp(np.clip(pairs, -20, 20))
    fwd, bwd = np.empty(len(odds)), np.full(len(odds), 0.5)
    fwd[start] = odds[start] / (1 + odds[start])
    for k in range(1, len(live)):
        at = start[: live[k]] + k
        g = fwd[at - 1]
        good = (p[0, 1] + g * (p[1, 1] - p[0, 1])) * odds[at]
        fwd[at] = good / (good + p[0, 0] + g * (p[1, 0] - p[0, 0]))
    for k in range(len(live) - 2, -1, -1):
        at = start[: live[k + 1]] + k
        good = odds[at + 1] * bwd[at + 1]
        bad = 1 - bwd[at + 1]
        one = p[1, 0] * bad + p[1, 1] * good
        bwd[at] = one / (one + p[0, 0] * bad + p[0, 1] * good)
    good = fwd * bwd
    good = good / np.maximum(good + (1 - fwd) * (1 - bwd), 1e-300)
    to = np.flatnonzero(np.append(False, doc[1:] == doc[:-1]))
    joint = np.stack([1 - fwd[to - 1], fwd[to - 1]], 1)[:, :, None] * p * np.stack([1 - bwd[to], odds[to] * bwd[to]], 1)[:, None, :]
    return good, (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0)


def fit(features: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 150, l2: float = 1e-4, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, pairs) that maximise the likelihood of every line of document i having label[i], by Adam on the whole sample.

    Features are scaled to a deviation of 1 meanwhile.
    """
    scale = np.maximum(features.std(0), 1e-3)
    scale[0] = 1
    features = features / scale
    y = label[doc]
    to = np.append(False, doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to], y[to]), 1)
    w = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        good, expected = marginals(features @ w[:-4], doc, w[-4:].reshape(2, 2))
        g = np.concatenate([features.T @ (y - good), (seen - expected).ravel()]) / len(y) - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-4] / scale, w[-4:].reshape(2, 2)


def document_scores(texts: Sequence[str], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(texts):
        return np.empty(0)
    features, chars, doc = line_features(texts)
    good, _ = marginals(features @ model[0], doc, model[1])
    weight = np.maximum(chars, 1)
    return np.clip(np.bincount(doc, good * weight) / np.bincount(doc, weight), 0, 1)


def held_out(id_col: str, folds: int = 5):
    return F.crc32(F.col(id_col).cast("string")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 2000, lines: int = 500_000):
    """The model, from at most `sample` labelled documents outside the held-out fold, `lines` lines in all; a float if there is nothing to tell apart."""
    ship(docs.sparkSession)
    ids = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(ids.select(F.col(id_col).alias("__i"), "__y")), F.col(id_col) == F.col("__i"))
    rows = rows.withColumn("__lines", F.length(F.coalesce(text_col, F.lit(""))) - F.length(F.replace(F.coalesce(text_col, F.lit("")), F.lit("\n"), F.lit(""))) + 1)
    upto = Window.orderBy(F.xxhash64(id_col), id_col, "__lines").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of the sample's rows
    rows = rows.withColumn("__upto", F.sum("__lines").over(upto)).where(F.col("__upto") <= lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                x, _, doc = line_features([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2).cast(pa.int64()), pa.array([x[doc == i].ravel() for i in range(part.num_rows)], pa.list_(pa.float64()))], names=["i", "y", "x"])

    got = rows.select(id_col, text_col, "__y").mapInArrow(run, "i long, y long, x array<double>").toArrow().to_pydict()
    order = sorted(range(len(got["i"])), key=lambda k: (got["i"][k], len(got["x"][k])))
    label = np.array([got["y"][k] for k in order], np.int64)
    if len(set(label.tolist())) < 2:
        return float(label[0]) if len(label) else 0.5
    width = 1 + 3 * len(OWN) + 2
    lines = [np.array(got["x"][k]).reshape(-1, width) for k in order]
    return fit(np.concatenate(lines), np.repeat(np.arange(len(lines)), [len(x) for x in lines]), (label > 0).astype(np.int64))


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, carry: Sequence[str] | None = None) -> DataFrame:
    """The carried columns of docs (all by default) with score and predicted (1 if score >= threshold)."""
    ship(docs.sparkSession)
    keep = with_result(docs, docs.columns if carry is None else carry, RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                s = np.full(len(texts), model) if isinstance(model, float) else document_scores(texts, model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=[*keep, *RESULTS])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "score double, predicted int"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
