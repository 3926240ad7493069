import random

import numpy as np
import pyarrow as pa
import pytest

from stagewise.llm import bpe, presplit
from stagewise.llm.bpe import Coder, bpe_digests, bpe_encode
from stagewise.llm.queries import tokenizer_path
from stagewise.llm.token_counts import TokenCounter, count_tokens
from tests.conftest import DATA

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'", "ll", "1", "23", "!!", "\x1c", "\x85", "\xa0", "日", "本", "<|endoftext|>", "aaa", "th", "ing", "the", "\r", "😀", "​"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", "a" * 300, " " * 50 + "x", "ab" * 500, "<|endoftext|>" * 3, "foo\n ", "a\n \nb"]


def test_automaton_is_the_library(library, texts):
    coder = Coder(PATH)
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(text) == e.ids, repr(text)
        assert coder.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_batches_are_the_library(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "PARTS", 50)  # parts are forgotten and encoded anew
    coder = Coder(PATH)
    for k in range(0, len(texts), 97):
        some = texts[k : k + 97]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        ids, n = coder.encode_batch(pa.array(some))
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert list(coder.written(ids, n)) == [",".join(map(str, x)).encode() for x in want]
        assert list(coder.decode_batch(ids, n)) == [library.decode(x, skip_special_tokens=False) for x in want]
    ids, n = coder.encode_batch(pa.array([], pa.string()))
    assert len(ids) == len(n) == 0 and list(coder.written(ids, n)) == []


def test_automaton_path_is_accepted(library):
    a = Coder(PATH).automaton
    ids = library.encode("Tokenization", add_special_tokens=False).ids
    assert all(a.follows(x, y) for x, y in zip(ids, ids[1:], strict=False))
    # the merge of t and h removed the path t, h
    assert not a.follows(library.token_to_id("t"), library.token_to_id("h"))


def test_compiled_transitions_are_those_of_the_gadgets():
    a = Coder(PATH).automaton
    rnd = random.Random(9)
    some = [i for i in a.labels if a.rank[i] >= 0 and len(a.labels[i]) < 5]
    x, y = (np.array(rnd.choices(some, k=20_000), np.int64) for _ in range(2))
    want = [a.follows(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert 0 < sum(want) < len(want)
    assert a.transitions(x, y).tolist() == want and a.transitions(x, y).tolist() == want


def test_counts_are_the_library(library, texts):
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(PATH).count(pa.array(texts)).tolist() == want
    assert len(TokenCounter(PATH).count(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (200, 4), (33, 16)])
def test_resynchronised_counts(library, texts, chunk, overlap):
    long = ["".join(texts[k : k + 12]) for k in range(0, 600, 12)] + ["x" * 2000, " " * 700, "word " * 400]
    counter = TokenCounter(PATH, chunk=chunk, overlap=overlap)
    for text in long:
        assert counter.encode_huge(text) == library.encode(text, add_special_tokens=False).ids
    assert counter.widened


def test_parts_are_sure():
    assert presplit.parts("foo\n ") == ["foo\n "]
    assert presplit.parts("a   b") == ["a", " ", "b"]
    assert presplit.parts("a  b") == ["a", "", "b"]
    assert presplit.parts(" a") == ["", "a"]


def test_queries_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "hello " * 40_000), (None, "x")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    want = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).collect())
    assert got == sorted((i or 0, len(t or ""), want[t], want[t] > 512) for i, t in rows)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe_digests(df, PATH).collect())
    assert got == sorted((i or 0, want[t]) for i, t in rows)
    enc = bpe_encode(df, PATH)
    assert enc.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert all(r.decoded == (r.text or "") and len(r.ids) == want[r.text] for r in enc.collect())
    assert count_tokens(df.limit(0), PATH).count() == bpe_digests(df.limit(0), PATH).count() == 0


def test_splices_at_every_size(library, texts):
    """Most texts here are longer than two chunks, and are spliced."""
    long = ["".join(texts[k : k + 5]) for k in range(0, 3000, 5)]
    counter = TokenCounter(PATH, chunk=16, overlap=8)
    assert counter.count(pa.array(long)).tolist() == [len(e.ids) for e in library.encode_batch(long, add_special_tokens=False)]
    assert counter.spliced > 500


def test_share_of_spliced_texts_of_the_table(spark, library, capsys):
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    counter = TokenCounter(PATH)
    assert counter.count(pa.array(texts)).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    with capsys.disabled():
        print(f" spliced: {counter.spliced} of {len(texts)} texts")
    assert counter.spliced


@pytest.mark.parametrize("chunk", [4096, 8])
def test_sentencepiece(spark, texts, chunk):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    some = ["hello world", "", "a b  c\n", "a \u2581 b", "x" * 50, *texts[:500], *(" ".join(texts[k : k + 3]) for k in range(500))]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    assert [r.n_tokens for r in count_tokens(df, path, chunk=chunk).orderBy("doc_id").collect()] == [len(lib.encode(t)) for t in some]
    counter = TokenCounter(path, chunk=8)
    assert counter.sure and counter.count(pa.array(some)).tolist() == [len(lib.encode(t)) for t in some] and counter.spliced > 50


def test_word_level_file(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    some = ["Hello  World", "", "a b\nc" * 3000]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    assert [r.n_tokens for r in count_tokens(df, path).orderBy("doc_id").collect()] == [len(lib.encode(t, add_special_tokens=False).ids) for t in some]
