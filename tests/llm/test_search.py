import math
import random
import re
from collections import Counter

from stagewise.llm import search as module
from stagewise.llm.search import search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AZ = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return [x.translate(AZ) for x in WORD.findall(text or "")]


def plain_search(docs, items, top):
    of = [(i, Counter(terms(t))) for i, t in docs]
    count, length = sum(bool(c) for _, c in of), sum(sum(c.values()) for _, c in of)
    df = Counter(x for _, c in of for x in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in of:
            n = sum(c.values())
            m = 50 + (50 * n * count) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if c[x])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top])]
    return Counter(out)


def tables(spark, seed):
    dice = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "x" * 400]
    say = lambda n: " ".join(dice.choice(words[: dice.choice([5, 20, 63])]).upper() if dice.random() < 0.2 else dice.choice(words) for _ in range(n))
    docs = [(k, "The " + say(dice.choice([0, 1, 5, 30, 200]))) for k in range(300)] + [(k, "the same text w1 w2") for k in range(400, 500)]
    docs += [(7, docs[7][1]), (None, "w1 w2 rare"), (None, None), (501, ""), (502, " .,- "), (503, "w3 " * 20_000)]
    items = [(k, say(dice.choice([1, 3, 12, 40]))) for k in range(25)] + [(90, "the"), (91, None), (92, "--"), (93, "nowhere"), (94, "w1 w1 W1 rare"), (95, "the same text w1 w2"), (None, "w5 w6")]
    return docs, items


def test_by_brute_force(spark):
    docs, items = tables(spark, 1)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, doc_id double")
    for top, entries in ((1, 100_000), (5, 40), (50, 7)):
        assert Counter(map(tuple, search(d, q, top, entries=entries).collect())) == plain_search(docs, items, top)
    assert search(d.limit(0), q).collect() == search(d, q.limit(0)).collect() == []


def test_large_tables_are_joined_and_lists_meet_items_in_groups(spark, monkeypatch):
    """The ways beyond the bounds: no list of terms in tasks, no broadcasts, several groups of items for a term."""
    for name in ("MOST_TERMS", "MOST_ROWS", "MOST_ITEMS"):
        monkeypatch.setattr(module, name, 3)
    docs, items = tables(spark, 2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, search(d, q, 5).collect())) == plain_search(docs, items, 5)


def test_lists_with_nothing_above_the_threshold(spark):
    """Copies raise an item's bound: a common term's list ends before its first entry, and so does one lot of several."""
    docs = [(k, "rare1 rare2 rare3") for k in range(60)] + [(100 + k, "common " + "other " * (20 + k)) for k in range(200)]
    items = [(1, "rare1 rare2 rare3 common"), (2, "rare1 rare2 rare3")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    for entries in (100_000, 20):
        assert Counter(map(tuple, search(d, q, 50, entries=entries).collect())) == plain_search(docs, items, 50)
