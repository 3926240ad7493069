import hashlib
import math
import random
import re
from collections import Counter

import pytest

from stagewise.llm.exact_dedup import exact_dedup
from stagewise.llm.near_dedup import least_agreement, near_duplicates, one_of_each, recall_of, trees_for
from stagewise.llm.substring_dedup import SuffixAutomaton, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if kind < 0.5:
            words = list(base)
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        elif kind < 0.6:
            words = base[:40] + words
        elif kind < 0.65:
            words = words[:3]
        text = " ".join(words)
        rows.append((3 * i - 40, text.upper() if rnd.random() < 0.2 else text if rnd.random() > 0.03 else None))
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "block": 8, "pivots": 2, "depth": 3, "recall": 0.99999}])
def test_near_duplicates(spark, options):
    rows = corpus(1)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, DOCS), shingle=4, **options).collect()}
    assert got == near_brute(rows, 4)


def test_near_duplicates_edges(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, text), (6, text), (None, text), (7, "a " * 20_000), (8, "a " * 20_000 + "b")]
    df = spark.createDataFrame([(*r, "x", False) for r in rows], DOCS + ", component_id string, kept boolean")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=4).collect())
    assert got == [(-1, 27, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 27, 6, True), (6, 27, 6, True), (7, 1, 7, True), (8, 2, 8, True)]
    assert near_duplicates(df.limit(0)).count() == 0
    assert one_of_each(df.where("doc_id > 0")).columns == df.columns


def test_trees():
    assert trees_for(0.9, 1) < trees_for(0.99, 1) < trees_for(0.99, 6)


def test_recall_at_the_threshold():
    from stagewise.llm.near_dedup import COORDINATES

    rnd = random.Random(5)
    trees = trees_for(0.998, 4)

    def together(agree, depth):
        """Whether a pair that agrees in so many coordinates shares a node at the depth."""
        if depth == 0:
            return True
        return any(together(agree, depth - 1) for _ in range(agree) if rnd.random() < 1 / (0.8 * COORDINATES))

    # how often one tree keeps the pair, for each number of agreeing coordinates; the trees share that number
    missed = 0.0
    for agree in range(38, COORDINATES + 1):
        chance = math.comb(COORDINATES, agree) * 0.8**agree * 0.2 ** (COORDINATES - agree)
        if chance > 1e-4:
            missed += chance * (1 - sum(together(agree, 4) for _ in range(3000)) / 3000) ** trees
    assert missed < 0.0022
    for recall in (0.998, 0.99999):
        need = least_agreement(0.8, recall)
        assert recall_of(trees_for(recall, 4), 4, 0.8, need) >= recall > recall_of(trees_for(recall, 4) - 1, 4, 0.8, need)


def test_exact_dedup(spark):
    rows = [(5, "a b"), (2, "ab "), (9, "a  b"), (3, "abc"), (1, None), (4, ""), (6, " \n"), (7, "z" * 100_000), (8, "z " * 100_000), (7, "y"), (7, "y"), (None, "ab")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", keep_id string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    want = sorted([(5, 9, 4, False), (2, 9, 4, False), (9, 9, 4, True), (None, 9, 4, False), (3, 3, 1, True), (1, 6, 3, False), (4, 6, 3, False), (6, 6, 3, True), (7, 8, 2, False), (8, 8, 2, True), (7, 7, 2, True), (7, 7, 2, True)], key=str)
    assert got == want
    assert exact_dedup(df.limit(0)).count() == 0


def test_exact_stage_keeps_one_row_of_each_text(spark):
    import corpus_pipeline

    rows = [(7, "y", 2), (7, "y", 1), (7, "y", 1), (8, "y", 0), (5, "a b", 0), (5, "ab", 0), (None, "z", 3), (None, "z", 4), (9, "alone", 0), (9, "other", 0)]
    df = spark.createDataFrame(rows, DOCS + ", kept int")
    got = sorted(map(tuple, corpus_pipeline.exact(spark, df, "").collect()), key=str)
    assert got == sorted([(7, "y", 1), (5, "a b", 0), (None, "z", 3), (9, "alone", 0), (9, "other", 0)], key=str)
    assert corpus_pipeline.exact(spark, df.limit(0), "").count() == 0


def test_automaton():
    rnd = random.Random(4)
    seen = [[rnd.choice("ab") for _ in range(rnd.randint(1, 12))] for _ in range(8)]
    a = SuffixAutomaton()
    for s in seen:
        a.add(s)
    inside = {"".join(s[i:j]) for s in seen for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(50):
        q = "".join(rnd.choice("abc") for _ in range(15))
        for k, n in enumerate(a.matches(list(q))):
            assert n == max((m for m in range(k + 2) if m == 0 or q[k + 1 - m : k + 1] in inside), default=0)


def clean_brute(rows, window=20):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            q = tuple(w[k : k + window])
            if q in first:
                gone.update(range(k, k + window))
            first.setdefault(q, i)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [1000, 2])
def test_remove_repeats(spark, most):
    rnd = random.Random(7)
    base = [rnd.choice("abcdefgh") if rnd.random() < 0.3 else str(rnd.randrange(300)) for _ in range(400)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 5)):
            kind, s = rnd.random(), rnd.randint(0, 380)
            w += base[s : s + rnd.randint(1, 60)] if kind < 0.5 else ["x"] * rnd.randint(1, 50) if kind < 0.6 else (["p", "q", "r"] * 30)[: rnd.randint(1, 60)] if kind < 0.7 else [str(rnd.randrange(1000)) for _ in range(rnd.randint(0, 30))]
        rows.append((2 * i - 30, None if i == 20 else " ".join(w)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, DOCS), digest=True, most=most).collect()}
    assert got == clean_brute(rows)
    assert Counter(n > 0 for _, n, _ in got.values())[True] > 20


def test_remove_repeats_of_rows_that_share_an_id(spark):
    """Of one id's texts, the one with the lesser hash comes first; nulls are one id."""
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    w60 = " ".join(str(rnd.randrange(1000)) for _ in range(60))
    rows = [(1, w60), (None, "x x x" + w60), (None, "x x x " + w60), (None, "short one"), (3, w60 + " end"), (3, "tiny text"), (3, "more " + w60), (3, "more " + w60), (2, None), (2, "")]
    df = spark.createDataFrame(rows, DOCS)
    order = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    keyed = sorted({(i if i is not None else -1, order[t], t) for i, t in rows}, key=lambda x: x[:2])
    want = clean_brute([(k, t) for k, (_, _, t) in enumerate(keyed)])
    want = sorted((i, *want[next(k for k, y in enumerate(keyed) if y[0] == i and y[2] == t)]) for i, t in ((i if i is not None else -1, t) for i, t in rows))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, digest=True).collect())
    assert got == want
    with pytest.raises(ValueError):
        remove_repeats(df, window=300)


def test_remove_repeats_edges(spark):
    text = " ".join(map(str, range(25)))
    rows = [(None, text), (1, text + " end"), (2, ""), (3, None), (4, "only a few words")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_words int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df).collect()}
    assert got == {None: (25, 0, text), 1: (26, 25, "end"), 2: (0, 0, ""), 3: (0, 0, ""), 4: (4, 0, "only a few words")}
    assert remove_repeats(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, text), (1, text), (2, text)], DOCS)
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(same).collect()) == [(1, 0), (1, 0), (2, 25)]


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (2, c + " more"), (2, c + " more"), (None, a)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df, shingle=4).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 2), (2, 2), (2, 2), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text[0]) for r in one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "a")], key=str)


def test_near_duplicate_recall_just_above_the_threshold(spark, capsys):
    """Planted pairs with a similarity of 0.80 to 0.85, among a crowd that shares a passage and gets branched."""
    rnd = random.Random(11)
    word = lambda: f"v{rnd.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows, pairs = [], []
    for i in range(700):
        words = [word() for _ in range(240)] if i % 2 else passage + [word() for _ in range(180)]
        other = list(words)
        while True:
            other[rnd.randrange(len(other))] = word()
            s, t = shingles(" ".join(words), 5), shingles(" ".join(other), 5)
            like = len(s & t) / len(s | t)
            if like < 0.86:
                break
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if 0.80 <= like <= 0.85:
            pairs.append(2 * i + 1)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, DOCS), leaf=50).collect()}
    recall = sum(got[i] == i - 1 for i in pairs) / len(pairs)
    with capsys.disabled():
        print(f" recall of {len(pairs)} pairs at 0.80 to 0.85: {recall:.4f}")
    assert len(pairs) > 300 and recall >= 0.99


def test_rows_of_large_groups_grow_in_proportion(spark, monkeypatch):
    """Members of nodes, over all levels, for 500 and 2,000 near-copies; one class each."""
    from stagewise.llm import near_dedup

    rows_of_levels = []
    write = near_dedup.checkpointed

    def counted(df):
        out = write(df)
        if df.columns == ["node", "rep", "large", "n"]:
            rows_of_levels.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "checkpointed", counted)
    sums = {}
    for n in (500, 2000):
        dice = random.Random(n)
        base = [f"w{dice.randrange(10**6)}" for _ in range(200)]
        rows = []
        for i in range(n):
            text = list(base)
            for _ in range(dice.randrange(6)):
                text[dice.randrange(200)] = f"x{dice.randrange(10**6)}"
            rows.append((i, " ".join(text)))
        rows_of_levels.clear()
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
        assert {r.component_id for r in got} == {0}
        sums[n] = sum(rows_of_levels)
    assert sums[2000] < 4.5 * sums[500]
    print(f"rows of nodes: {sums}")


def test_rows_of_a_crowd_are_left_out_of_the_trees(spark, monkeypatch):
    """Members of nodes for 1,500 near-copies among others; the crowd is one class and the others are none of it."""
    from stagewise.llm import near_dedup

    members = []
    write = near_dedup.checkpointed

    def counted(df):
        out = write(df)
        if df.columns == ["node", "rep", "large", "n"]:
            members.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "checkpointed", counted)
    dice = random.Random(2)
    base = [f"w{dice.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        text = list(base)
        for _ in range(dice.randrange(6)):
            text[dice.randrange(200)] = f"x{dice.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(2000 + i, " ".join(f"y{dice.randrange(10**6)}" for _ in range(100))) for i in range(200)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=4).collect()}
    assert got == {i: 0 if i < 1500 else i for i, _ in rows}
    assert sum(members) < 1500


@pytest.mark.parametrize("crowd", [5, 20])
def test_near_duplicates_with_crowds(spark, monkeypatch, crowd):
    """Several small crowds with a centre each, and a passage that unlike texts share, against all pairs."""
    from stagewise.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    dice = random.Random(crowd)
    word = lambda: f"w{dice.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i - 30, text) for i, text in corpus(crowd, 120)]
    for group in range(3):
        base = [word() for _ in range(100)]
        for i in range(50):
            text = list(base)
            for _ in range(dice.randrange(12)):
                text[dice.randrange(100)] = word()
            rows.append((1000 * (group + 1) + i, " ".join(text)))
    rows += [(9000 + i, " ".join(passage + [word() for _ in range(dice.randrange(20, 80))])) for i in range(60)]
    found = []
    look = near_dedup.centres
    monkeypatch.setattr(near_dedup, "centres", lambda *x: found.append(look(*x)) or found[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=4, recall=0.99999).collect()}
    assert len(found[0][0]) > 1
    assert got == near_brute(rows, 4)
