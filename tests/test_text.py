import pytest
from pyspark.sql import functions as F

from stagewise.functions import text as X
from stagewise.functions import titles
from stagewise.operators import guards, structure


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "written, want",
    [
        ("1977-05-08", "1977-05-08"),
        ("5/8/77", "1977-05-08"),
        ("5/8/1977", "1977-05-08"),
        ("5/8/04", "2004-05-08"),
        ("Sunday, May 8, 1977", "1977-05-08"),
        ("8 May 1977", "1977-05-08"),
        ("May 8th", "--05-08"),
        ("Sept 3, 1980", "1980-09-03"),
        ("2/30/77", "1977-02-30"),
        ("soon", None),
        ("Ma 8, 1977", None),
    ],
)
def test_normalize_date(spark, written, want):
    assert one(spark, X.normalize_date("d"), d=written) == want


@pytest.mark.parametrize("written, want", [("4:05", 245.0), ("1:02:03", 3723.0), ("71.5", 71.5), ("x:1", None), ("", None), ("1:2:3:4", None)])
def test_length_seconds(spark, written, want):
    assert one(spark, X.length_seconds("d"), d=written) == want


def test_small_functions(spark):
    assert one(spark, X.slug("c"), c="  Téxas & Co. ") == "t-xas-co"
    assert one(spark, X.slug("c"), c="!!") == "unknown"
    assert one(spark, X.first_of("c"), c='["a", "b"]') == "a"
    assert one(spark, X.first_of("c"), c="plain") == "plain"
    assert one(spark, X.valid_year("c"), c="1977-05") == 1977
    assert one(spark, X.valid_year("c"), c="0001") is None
    assert one(spark, X.try_int("c"), c="x1") is None
    assert one(spark, X.newest_number("c"), c="gd77.sbd.123.98765") == 98765
    assert one(spark, X.format_count("c"), c=999_950) == "1.0M"
    assert one(spark, X.format_count("c"), c=1_500) == "1.5k"
    assert one(spark, X.format_duration("c"), c=3725.0) == "1:02:05"
    assert one(spark, X.packaged_filename(F.lit(3), F.lit("A/B  c"), F.lit(".mp3"))) == "03 - A_B c.mp3"
    assert one(spark, X.speech("c", {"St": "Saint", "St Louis": "Saint Lewis"}), c="St Louis > 5% & St") == "Saint Lewis into 5 percent and Saint"
    assert one(spark, X.event_kind("c"), c="gd/1977-05-08/e2") == "event 2"
    assert one(spark, X.parse_performance_id("c"), c="gd/1977-05-08/e2").event == 2
    assert one(spark, X.parse_performance_id("c"), c="gd/soon") is None
    assert one(spark, X.artist_key("c"), c="Béla & Co.") == "bélaandco"


def test_contains_sequence(spark):
    said = F.lit("bertha and gt me and my uncle sugaree")
    assert one(spark, X.contains_sequence(said, ["bertha", "me and my uncle", "sugaree"]))
    assert not one(spark, X.contains_sequence(said, ["sugaree", "bertha"]))
    assert not one(spark, X.contains_sequence(said, ["bert"]))
    assert one(spark, X.contains_sequence(F.lit("a b"), ["a", "b"]))


def test_titles():
    assert titles.parts("China Cat > Rider (live)") == ["china cat sunflower", "i know you rider"]
    assert titles.parts("(Tape Flip)") == ["tape flip"]
    assert titles.fuzzy("Encore: Samson & Delilah") == "samson and delilah"
    assert titles.same_song("mississippi half step", "mississippi half step uptown toodeloo")
    assert not titles.same_song("dew", "morning dew")
    assert not titles.same_song(*titles.DIFFERENT)
    assert titles.same_song("sugar ee", "sugaree")
    assert titles.fuzzy("Scarlet", titles.SHORTHAND) == "scarlet begonias"


def test_native_and_plain_titles_agree(spark):
    said = ["Franklin's Tower", "Franklin’s Tower", "China Cat > Rider (live)", "E: Me & My Uncle", "(Tape Flip)", "Scarlet -> Fire →", "Playin' In The Band (reprise) (SBD)", "a (b (c)", "encore : x", "St. Stephen (x) y", "  ", "U.S. Blues", "C.C. Rider", "élan vital"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, x string")
    got = df.select("k", X.fuzzy_title("x").alias("f"), X.title_parts("x", titles.SHORTHAND).alias("p"), X.is_filler("x").alias("t")).collect()
    for r in got:
        assert (r.f, r.p) == (titles.fuzzy(said[r.k]), titles.parts(said[r.k], titles.SHORTHAND)), said[r.k]
    pairs = [(a, b) for a in map(titles.normal, said) for b in [*map(titles.normal, said), "mississippi half step", *titles.DIFFERENT, "franklinstower"]] + [titles.DIFFERENT, ("dew", "morning dew"), ("half step", "mississippi half step")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.same == titles.same_song(r.a, r.b) for r in df.select("a", "b", X.same_song(F.col("a"), F.col("b")).alias("same")).collect())


def test_guards(spark):
    assert one(spark, guards.set_count_claims(F.lit("Two sets, then 3 long sets; both sets"))) == [2, 3, 2]
    dates = F.array(F.lit("1977-05-08"), F.lit("1977-05-08"))
    assert one(spark, guards.adopted_date(dates, F.lit("1977-01-01"))) == "1977-05-08"
    assert one(spark, guards.adopted_date(dates, F.lit("1978-01-01"))) is None
    assert one(spark, guards.dates_disagree(F.array(F.lit("--05-08"), F.lit("1977-05-09")), F.lit("1977-05-08"))) == ["1977-05-09"]
    flags = one(spark, guards.prose_guard(F.lit("three sets"), F.lit(2), F.array(F.lit("x")), F.array(F.lit("y")), F.array(F.lit("1"), F.lit("4"))))
    assert flags == ["unknown songs: x", "unknown sets: 4", "claims 3 sets"]


def test_resolve_positions(spark):
    lists = lambda *xs: F.array(*[F.array(*[F.lit(i) for i in x]).cast("array<int>") for x in xs])
    assert one(spark, structure.resolve_positions(lists([1, 4, 9], [3, 8]))) == [4, 8]
    assert one(spark, structure.resolve_positions(lists([9], [3, 8]))) is None
    assert one(spark, structure.resolve_positions(lists([], [3]))) is None


def test_setlist_service(spark):
    kind = "show string, sets array<struct<encore:int,song:array<struct<name:string,tape:boolean>>>>"
    song = lambda *names: [(n, None) for n in names]
    df = spark.createDataFrame([("a", [(None, song("x", "y", "")), (None, song("z", "v")), (1, [("u", None), ("intro", True)])]), ("b", [(None, song("x"))])], kind)
    got = [(r.show, r.pos, r.title, r.set_label) for r in structure.from_setlist_service(df, "show", "sets").orderBy("pos").collect()]
    assert got == [("a", 1, "x", "1"), ("a", 2, "y", "1"), ("a", 3, "z", "2"), ("a", 4, "v", "2"), ("a", 5, "u", "encore")]
