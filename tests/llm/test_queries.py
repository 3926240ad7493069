import hashlib
import zlib

import pytest

from stagewise.llm import queries
from tests.conftest import DATA, rows_of
from tests.llm.plain import plain_fingerprint, plain_likeness, plain_score, plain_text
from tests.llm.test_dedup import clean_brute, near_brute


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toArrow(), duck.sql(queries.oracle_sql()[name]).to_arrow_table()
    assert rows_of(got.to_pandas(integer_object_nulls=True)) == rows_of(want.to_pandas(integer_object_nulls=True))


def test_queries_without_sql():
    """Each of them is compared with a plain version below (op13 in test_packing.py)."""
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"op2_token_counts", "op3_near_dedup", "op4_fingerprints", "op5_substring_dedup", "op6_quality", "op7_html_text", "op10_bpe", "op13_packing"}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def encoded(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in documents}
    return {i: (x, library.decode(x, skip_special_tokens=False)) for i, x in ids.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2_is_the_library(spark, documents, encoded):
    got = {tuple(r) for r in queries.op2_token_counts(spark, DATA).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {(i, len(t.encode()), len(encoded[i][0]), len(encoded[i][0]) > 512) for i, t in documents}


def test_op3_by_brute_force(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_near_dedup(spark, DATA).collect()}
    assert got == near_brute(documents, 4)
    assert sum(not kept for _, _, kept in got.values())


def test_op4_by_plain_fingerprints(spark, documents):
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, DATA).collect()}
    order = sorted(documents, reverse=True)
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), sha(edited))
        if k % 4 == 0:
            f, g, h = (plain_fingerprint(x) for x in (text, edited, after))
            assert (got[i].fingerprint, got[i].edited_fingerprint) == (f, g)
            assert got[i].near_edited == pytest.approx(plain_likeness(f, g)) and got[i].near_next == pytest.approx(plain_likeness(f, h))


def test_op5_by_brute_force(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring_dedup(spark, DATA).collect()}
    assert got == clean_brute(documents)
    assert sum(n > 0 for _, n, _ in got.values()) > 10


def test_op6_by_plain_sums(spark, documents):
    from stagewise.llm.quality import train

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = train(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
    got = {r.doc_id: r for r in queries.op6_quality(spark, DATA).collect()}
    for i, text in documents:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].score == pytest.approx(plain_score(text, model), abs=1e-6)
        assert got[i].predicted == int(got[i].score >= 0.3)
    held = {r.doc_id: r.quality for r in labels.collect() if got[r.doc_id].held_out}
    assert sum(got[i].predicted == q for i, q in held.items()) >= 0.9 * len(held)


def test_op7_by_plain_parsing(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op7_html_text(spark, DATA).collect()}
    assert len(got) == len(pages)
    for r in pages:
        assert got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)
        want = plain_text(r.html or "")
        assert want is None or got[r.page_id].text == want, r.page_id


def test_op10_is_the_library(spark, encoded):
    got = {tuple(r) for r in queries.op10_bpe(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(i, len(x), sha(",".join(map(str, x))), sha(t)) for i, (x, t) in encoded.items()}


def test_pipeline_by_brute_force(spark, duck):
    """Each stage against a plain version of it, on its own input."""
    import corpus_pipeline
    from stagewise.llm.mixing import mix

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}

    first = stages["quality classifier"](spark, docs, DATA).cache()
    assert first.columns == columns
    kept = {r.doc_id for r in first.collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9

    second = stages["exact dedup"](spark, first, DATA).cache()
    groups = {}
    for r in first.collect():
        groups.setdefault("".join((r.text or "").split()), []).append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in second.collect()} == {min(g)[1] for g in groups.values()}

    third = stages["near dedup"](spark, second, DATA).cache()
    want = near_brute([(r.doc_id, r.text) for r in second.collect()], 5)
    assert {r.doc_id for r in third.collect()} == {i for i, (_, _, k) in want.items() if k}
    assert third.columns == columns

    fourth = stages["mixing"](spark, third, DATA).cache()
    taken = {r.doc_id: r.taken / r["size"] if r["size"] else 0 for r in mix(third).collect()}
    counts = {}
    for r in fourth.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: int(x + 0.5) for i, x in taken.items() if int(x + 0.5)}
    assert fourth.columns == columns

    last = stages["bpe"](spark, fourth, DATA)
    assert last.columns == [*columns, "ids", "decoded"]
    assert all(r.decoded == r.text and r.ids for r in last.collect())
    assert corpus_pipeline.run(spark, DATA).count() == fourth.count()


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, empty and long texts, extra columns named like results; and no rows at all."""
    import corpus_pipeline

    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(i, words(i, 30 + i), "en", "ab"[i % 2], 5, "s", 1.5, True) for i in range(30)]
    rows += [rows[3], (100, rows[3][1], "en", "a", 5, "s", 1.5, True), (None, words(200, 40), None, None, None, None, None, None), (None, words(201, 40), None, None, None, None, None, None), (101, None, "en", "a", 1, "s", 1.0, False), (102, "", "en", "b", 1, "s", 1.0, False), (103, words(7, 37) + " more", "en", "b", 1, "s", 1.0, False), (104, "long " * 30_000, "en", "a", 1, "s", 1.0, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, score string, target double, kept boolean")
    spark.createDataFrame([(i, int(i < 25)) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (df, df.limit(0)):
        kept = docs
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path)).cache()
            assert kept.columns[:8] == df.columns
        assert (kept.count() > 20) == (docs is df)
        assert all(r.decoded == (r.text or "") for r in kept.collect())
    third = dict(corpus_pipeline.STAGES)["near dedup"](spark, dict(corpus_pipeline.STAGES)["exact dedup"](spark, df, str(tmp_path)), str(tmp_path))
    ids = [r.doc_id for r in third.collect()]
    assert ids.count(3) == 1 and 100 not in ids and 103 not in ids and ids.count(None) == 2
