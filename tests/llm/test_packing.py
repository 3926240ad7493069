import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stagewise.llm import queries
from stagewise.llm.packing import best_fit, cut, ids_of, packed, sequences
from tests.conftest import DATA


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def plain_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def checked(rows, limit=1024):
    """Sequences without gaps or overlaps, none longer than the limit; how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_op13_is_the_library_and_fits_well(spark, library):
    rows = queries.op13_packing(spark, DATA).collect()
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = plain_ids(library, r.text)
        for k, (start, n) in enumerate(cut(len(ids), 1024)):
            want[r.doc_id, k] = (start, n, zlib.crc32(np.array(ids[start : start + n], "<u4")))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert checked(rows) <= 1.02 * (sum(n for _, n, _ in want.values()) // 1024 + 1)


def plain_best_fit(lengths, limit):
    """How many sequences best fit decreasing takes, one piece at a time."""
    room = Counter()
    for n in sorted(lengths, reverse=True):
        at = min((r for r in room if r >= n and room[r]), default=limit)
        if room[at]:
            room[at] -= 1
        room[at - n] += 1
    return sum(room.values())


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    dice = random.Random(seed)
    limit = dice.choice([7, 20, 64])
    lengths = [min(limit, int(dice.expovariate(4 / limit)) + 1) for _ in range(dice.choice([1, 40, 700]))] + [3] * dice.choice([0, 500])
    slots = best_fit(Counter(lengths), limit)
    seen, counts = {}, Counter(lengths)
    ends = {}
    for length, rank, each, sequence, offset in sorted(slots):
        ends.setdefault(length, []).append((rank, each, sequence, offset))
    for length, parts in ends.items():
        for (rank, each, sequence, offset), stop in zip(parts, [*(p[0] for p in parts[1:]), counts[length]], strict=True):
            for k in range(stop - rank):
                seen.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert Counter(n for parts in seen.values() for _, n in parts) == counts
    assert len(seen) == plain_best_fit(lengths, limit)


def test_plan_of_many_pieces_is_small():
    slots = best_fit({n: 10**9 + n * 7919 for n in range(1, 1025)}, 1024)
    assert len(slots) < 100_000


def test_every_token_has_one_way_of_merging(library):
    """What lets ranks stand for merges: two tokens that spell a third one, but aren't its halves, never meet."""
    from stagewise.llm.bpe import coder

    a = coder(queries.tokenizer_path()).automaton
    ids = {label: i for i, label in a.labels.items() if i not in a.special.values()}
    dice = random.Random(5)
    for label, c in dice.sample(sorted(ids.items()), 8000):
        for k in range(1, len(label)):
            x, y = ids.get(label[:k]), ids.get(label[k:])
            if x is not None and y is not None and (x, y) != tuple(a.halves[c].tolist()):
                assert not a.follows(x, y) or a.rank[c] < max(a.rank[x], a.rank[y])


def test_odd_texts_are_the_library(library):
    encode = ids_of(queries.tokenizer_path())
    odd = ["", " ", "a<|endoftext|>b", "x" * 5000, " " * 5000 + "y", "日本 語　x", "\x85\x1c a b", "naïve – “q” €5", "🙂🙂 ok", "it's we'LL 12ab\n\n  z", "͸\U0001e900", "a\x00b", "é"]
    for text in odd:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_tables(spark, library):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 1, "x"), (2, "", 1, None), (3, "word " * 3000, 1, "y"), (None, "z", 0, "z")] + [(k, "same text", 0, "s") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string").repartition(5)
    out = packed(df, queries.tokenizer_path(), limit=64).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = plain_ids(library, text)
        want.update((i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4"))) for k, (start, n) in enumerate(cut(len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    checked(out, 64)
    assert packed(df.limit(0), queries.tokenizer_path()).collect() == []
    whole = sequences(df, queries.tokenizer_path(), limit=64).collect()
    assert all(len(r.ids) <= 64 for r in whole)
    assert sum(len(r.ids) for r in whole) == sum(len(plain_ids(library, t)) for _, t, *_ in rows)
    assert sum(r.ids.count(2) for r in whole) >= len(rows)
