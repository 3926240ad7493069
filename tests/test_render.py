from pyspark.sql import functions as F

from stagewise.functions import render


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lines(spark):
    df = spark.createDataFrame([("a", 2, "Two", True, None), ("a", 1, "One", False, 61.0)], "show string, i int, t string, s boolean, d double")
    text = lambda line: render.lines_of(df, ["show"], ["i"], line).first().text
    assert text(render.setlist_line(F.lit("1"), F.col("t"), F.col("s"))) == "[set 1] One\n[set 1] Two >"
    assert text(render.track_line(F.col("i"), F.lit("f"), F.col("t"), F.col("d"))) == "1 | f | One | 61.0\n2 | f | Two | ?"


def test_texts(spark):
    ts = lambda s: F.to_timestamp(F.lit(s))
    assert one(spark, render.age(ts("2020-01-01 00:00:00"), ts("2020-01-01 03:59:00"))) == "3h"
    assert one(spark, render.age(ts("2020-01-02"), ts("2020-01-01"))) == "0s"
    assert one(spark, render.ranks(F.lit("1, x,3,3"))) == [1, 3]
    null = F.lit(None).cast("string")
    assert one(spark, render.discovery_query(F.lit("q"), F.lit("1970"), null)) == "q\nEra: 1970 to any"
    assert one(spark, render.discovery_query(F.lit("q"), null, null)) == "q"
    assert one(spark, render.vetting_text(F.array(F.lit("a"), F.lit("b")), null, F.lit("c"))) == "Flags: a; b\nContext: c"
    assert one(spark, render.escaped_metadata(F.lit("a=b;c#d\\e"))) == "a\\=b\\;c\\#d\\\\e"
    assert one(spark, render.artist_line(F.lit("x"), F.lit("X"), F.lit(3), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1500))) == "x | X | 3 recordings | ? | 1.5k downloads"


def test_files(spark):
    df = spark.createDataFrame([("a", 1, "it's; one", 0, 1000), ("a", 2, "two", 1000, 1500)], "show string, i int, t string, s long, e long")
    assert render.chapters(df, "show", "i", "t", "s", "e").first().text == ";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1000\ntitle=it's\\; one\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=1000\nEND=1500\ntitle=two\n"
    assert render.concat_list(df, "show", "i", "t").first().text == "file 'it'\\''s; one'\nfile 'two'\n"
    got = render.with_neighbours(df, "show", "i", "t").orderBy("i").collect()
    assert (got[0].previous_text, got[0].next_text, got[1].previous_text) == (None, "two", "it's; one")


def test_sentences():
    assert render.sentences("This is the first of them. And this is another one! Ok.") == ["This is the first of them.", "And this is another one! Ok."]
    assert render.sentences("They played at St. Louis Arena that whole year. It was the best of all.") == ["They played at St. Louis Arena that whole year.", "It was the best of all."]
    assert render.sentences("The great old singer was J. Garcia of course, friends.") == ["The great old singer was J. Garcia of course, friends."]
    assert render.sentences(" ") == [""]


def test_wrapping(spark):
    import random
    import textwrap

    rnd = random.Random(8)
    texts = [" ".join("x" * rnd.randint(1, 14) for _ in range(rnd.randint(0, 40))) for _ in range(60)] + ["", "  a \n b  ", "y" * 45]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    for r in df.select("k", render.wrapped(F.col("x"), 20, None).alias("all"), render.wrapped(F.col("x"), 20).alias("some")).collect():
        want = textwrap.wrap(" ".join(texts[r.k].split()), width=20)
        assert r["all"] == want, texts[r.k]
        assert r["some"] == (want if len(want) <= 3 else [*want[:2], want[2] + " …"])
