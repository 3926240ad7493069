"""Cases of the rules over titles, labels, tags and prose, judged by hand."""

import pytest
from pyspark.sql import functions as F

from stagewise.functions import text as X
from stagewise.functions.setlist import is_gear
from stagewise.functions.titles import is_filler
from stagewise.operators import guards, structure
from stagewise.plans.shows import LABELS


TAGS = [
    ("gd73-06-10d1t04 Here Comes Sunshine", "Here Comes Sunshine", True),
    ("gd1973-06-10 Deal", "Deal", True),
    ("phil_99.04.15t02Jam.flac", "Jam", True),
    ("unknown", "", False),
    (" - Unknown . ", "", False),
    ("Sugaree.mp3 ", "Sugaree", True),
    ("Sugaree.wav", "Sugaree.wav", True),
    ("d1t02", "d1t02", False),
    ("__Ripple__", "Ripple", True),
    ("", "", False),
    (None, "", False),
    ("1952 Vincent Black Lightning", "1952 Vincent Black Lightning", True),
    ("Dark Star | ", "Dark Star", True),
    ("x77-05-08 Morning Dew", "x77-05-08 Morning Dew", True),
]

FILLERS = [
    ("Crowd noise and tuning", True),
    ("Tuning/Applause", True),
    ("tune-up", True),
    ("Stage repairs", True),
    ("equipment problems", True),
    ("Band intros by Phil", True),
    ("Intro by Fiona Black", True),
    ("Bill Graham announcement", True),
    ("stage talk", True),
    ("Encore  Break", True),
    ("soundcheck jam", True),
    ("outro", True),
    ("Drums", False),
    ("Space", False),
    ("Feedback", False),
    ("Talkin' World War III Blues", False),
    ("Chattanooga Choo Choo", False),
    ("Introspection", False),
    ("Tune", False),
    ("Set Break", False),
    ("", False),
    (None, False),
]

CLAIMS = [("They played two sets that night.", "2"), ("Both sets; 3 long sets and FOUR sets", "2,3,4"), ("two sets of strings", ""), ("one set, single set, a two-set show", ""), ("five sets", ""), ("the second set", ""), (None, "")]


def answers(spark, cases, result):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    return [r[0] for r in df.orderBy("k").select(result).collect()]


def test_labels(spark):
    assert answers(spark, [c for c, _ in LABELS], structure.set_label("c")) == [x for _, x in LABELS]


def test_tags(spark):
    assert answers(spark, [c for c, *_ in TAGS], X.clean_tag("c")) == [x for _, x, _ in TAGS]
    assert answers(spark, [c for _, c, _ in TAGS], X.is_real_title("c")) == [x for *_, x in TAGS]


def test_fillers(spark):
    assert answers(spark, [c for c, _ in FILLERS], X.is_filler("c")) == [x for _, x in FILLERS]
    assert [is_filler(c or "") for c, _ in FILLERS] == [x for _, x in FILLERS]


def test_claims(spark):
    got = answers(spark, [c or "" for c, _ in CLAIMS], F.array_join(guards.set_count_claims(F.col("c")).cast("array<string>"), ","))
    assert got == [x for _, x in CLAIMS]


def test_lineage(spark):
    cases = {"SBD > DAT": "sbd", "soundboards": "sbd", "sbdx": "unknown", "mtx": "matrix", "a mtx, sbd": "matrix", "Matrixed": "matrix", "audience": "aud", "audiences": "unknown", "AUD": "aud", "auditorium": "unknown", "schoeps mk4": "unknown", "": "unknown"}
    assert answers(spark, list(cases), X.lineage_class("c")) == list(cases.values())


@pytest.mark.parametrize("title", ["Telefunken M62", "SKM140", "12' stand", '7" reel', "Sony PCM-M10", "mz-m200", "skm-140", "24 bit", "24bit/96khz", "row 12", "CD Audio", "cdaudio", "audio-technica", "@ 48", "~ 20 ft", "~ here", "www.x.org", "Right of SBD", "remastered", "Schoeps MK4s", "resampling", "xlrs"])
def test_gear(title):
    assert is_gear(title)


@pytest.mark.parametrize("title", ["t01) Bertha", "d101", "A01. Deal", "B07.", "Zoom", "Audience", "Sugaree", "Row Jimmy", "Truckin'", "Right On", "U2", "50 Ways", "It's 5 o'clock", "Channeling", "1952 Vincent Black Lightning"])
def test_no_gear(title):
    assert not is_gear(title)
