from stagewise.plans import gather, shortlist


def test_gather(spark):
    files = []
    names = ["Bertha", "Sugaree", "Deal", "Drums", "Space", "One More"]
    for k, t in enumerate(names, 1):
        files.append(("s", f"gd{k:02d}.flac", "original", None, "Flac", "4:00", str(k), t, 2 * k))
        files.append(("s", f"gd{k:02d}.mp3", "derivative", f"gd{k:02d}.flac", "VBR MP3", "4:00", str(k), f"{k:02d} {t}", 2 * k + 1))
    files.append(("s", "spam1.mp3", "original", None, "VBR MP3", "0:29", None, "Buy", 99))
    files = spark.createDataFrame(files, "show string, name string, source string, original string, format string, length string, track string, title string, pos int")
    text = "My Band<br>Big Hall<br>Set 1: Bertha > Sugaree, Deal<br>Set 2: Drums > Jam<br>Encore: One More"
    descriptions = spark.createDataFrame([("s", 0, "nothing here"), ("s", 1, text)], "show string, pos int, text string")
    shows = spark.createDataFrame([("s", "My Band", "Big Hall", "Town", "1977-05-08")], "show string, artist string, venue string, city string, date string")
    none = spark.createDataFrame([], "show string, k int, name string, closer string")
    tracks, flags = gather.gather(files, descriptions, shows, none)
    got = [(r["index"], r.title, r.set_label, r.segue, r.matched) for r in tracks.orderBy("index").collect()]
    assert got == [(1, "Bertha", "1", True, True), (2, "Sugaree", "1", False, True), (3, "Deal", "1", False, True), (4, "Drums", "2", True, True), (5, "Space", "2", False, True), (6, "One More", "encore", False, True)]
    assert flags.count() == 0
    closers = spark.createDataFrame([("s", 1, "1", "Sugaree"), ("s", 2, "2", "Space"), ("s", 3, "encore", "One More")], none.schema)
    tracks, flags = gather.gather(files, descriptions, shows, closers)
    assert [r.set_label for r in tracks.orderBy("index").collect()] == ["1", "1", "2", "2", "2", "encore"]


def test_shortlist(spark):
    rows = [(f"i{k}", "abc"[k % 3], f"197{k % 10}-01-{k % 28 + 1:02d}T00:00", "Hall" if k % 2 else "", "bertha deal" if k % 4 else "deal", 3.0 + k % 3, 2 + k % 5, k) for k in range(60)]
    rows.append(("u", "a", None, "Hall", "", 5.0, 99, 60))
    items = spark.createDataFrame(rows, "identifier string, collection string, date string, venue string, description string, rating double, reviews int, pos int")
    seen = spark.createDataFrame([("b/1971-01-02",)], "id string")
    scores = spark.createDataFrame([(f"{'abc'[k % 3]}/197{k % 10}-01-{k % 28 + 1:02d}", float(k % 11), k) for k in range(60)], "performance_id string, quality_score double, pos int")
    got = shortlist.shortlist(items, [seen], scores, sequences=[["bertha", "deal"]], count=5, floor=3.0).orderBy("rank").collect()
    assert 0 < len(got) <= 5 and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert all(r.performance_id != "b/1971-01-02" and r.rating >= 3.5 and r.quality_score >= 3 for r in got)
