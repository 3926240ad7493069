from pyspark.sql import functions as F

from stagewise.sources import settings


def test_profiles(spark, tmp_path):
    files = {
        "good": 'name = "Tour"\nhuman_gate = true\n[criteria]\nquery = "spring"\nartists = ["A", "B"]\n[[criteria.setlist_constraints]]\nsequence = ["x", "y"]\n',
        "broken": 'name = "x',
        "type": 'name = "x"\ncount = "three"\n[criteria]\nquery = "q"\n',
        "inner": 'name = "x"\n[criteria]\nquery = "q"\nmin_reviews = "many"\n',
        "flat": 'name = "x"\ncriteria = "q"\n',
        "cap": 'name = "x"\n[criteria]\nquery = "q"\nartist_cap = 0\n',
        "missing": 'name = "x"\n[criteria]\nartist = "a"\n',
        "empty": "",
    }
    (tmp_path / "profiles").mkdir()
    for name, text in files.items():
        (tmp_path / "profiles" / f"{name}.toml").write_text(text)
    (tmp_path / "profiles" / "note.txt").write_text("no profile")
    texts = settings.toml_texts(spark, str(tmp_path / "profiles"))
    got = {r.file: r for r in settings.profiles(texts).collect()}
    errors = {k: r.error for k, r in got.items()}
    assert errors.pop("broken").startswith("no TOML")
    assert errors == {"good": None, "type": "count: no int", "inner": "min_reviews: no int", "flat": "criteria: no table", "cap": "artist_cap isn't above 0 and up to 1", "missing": "criteria.query is missing", "empty": "name is missing"}
    good = got["good"]
    assert (good["name"], good["count"], good.human_gate, good.criteria.artists, good.criteria.min_reviews, good.criteria.year_cap) == ("Tour", 1, True, ["A", "B"], 3, 1.0)
    assert good.criteria.setlist_constraints[0].sequence == ["x", "y"]
    assert settings.profiles(settings.toml_texts(spark, str(tmp_path / "nowhere"))).count() == 0


def test_presenters_and_models(spark):
    rows = [("casey", 'name = "C"\nsex = "f"\ncharacter = "warm"\nvoice = "v1"'), ("both", 'name = "C"\nsex = "f"\ncharacter = "w"\nvoice = "v1"\nvoice_clone = "a.wav"'), ("none", 'name = "C"\nsex = "f"\ncharacter = "w"'), ("clone", 'name = "C"\nsex = "f"\ncharacter = "w"\nvoice_clone = "a.wav"'), ("null", None)]
    got = {r.id: (r.voice_id, r.error) for r in settings.presenters(spark.createDataFrame(rows, "name string, text string")).collect()}
    need = "exactly one of voice and voice_clone is needed"
    assert got == {"casey": ("v1", None), "both": ("v1", need), "none": (None, need), "clone": ("a.wav", None), "null": (None, "name is missing")}
    text = '[llm.default]\nprovider = "p"\n[llm.vet]\ntier = "high"\n[llm.tiers.p]\nlow = "m1"\nhigh = "m2"\n'
    models = settings.model_settings(spark.createDataFrame([("a", text), ("b", "x = 1"), ("c", "[[")], "name string, text string"))
    found = {r.name: r for r in models.withColumns({"vet": settings.setting_for(F.col("tasks"), "vet"), "brief": settings.setting_for(F.col("tasks"), "brief")}).collect()}
    assert found["a"].tiers == {"p": {"low": "m1", "high": "m2"}} and found["a"].vet == {"tier": "high"} and found["a"].brief == {"provider": "p"}
    assert found["b"].tasks is None and found["b"].error is None and found["c"].error.startswith("no TOML")
