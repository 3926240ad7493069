"""The operators over titles, evidence, descriptions and prose, bound to the test tables, each with SQL that gives the same rows.

Titles, labels, tags and prose are dealt to the tables' rows in turn. Where SQL can't express a rule, its cases are
written out with what must come of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from stagewise.functions import text as X
from stagewise.functions.titles import ALIASES, FILLER_STEMS, FILLER_WORDS, SHORTHAND
from stagewise.operators import catalog, files, guards, manifest, recovery, structure
from stagewise.operators import library as shelf
from stagewise.plans import gather as gathering
from stagewise.plans.bindings import LINES
from stagewise.plans.registry import literal, query, t, values


def dealt(spark, rows, columns: str):
    """A small table of cases with i, its place."""
    return F.broadcast(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, " + columns))


#: A track's title, and how evidence names the song that closes it.
SONGS = [
    ("Bertha", "Bertha"),
    ("China Cat Sunflower > I Know You Rider", "I Know You Rider"),
    ("Me & My Uncle", "Me and My Uncle"),
    ("Not Fade Away Chant", "Not Fade Away"),
    ("Scarlet -> Fire", "Fire on the Mountain"),
    ("Caution (Do Not Step)", "Caution (Do Not Stop on Tracks)"),
    ("Encore: U.S. Blues", "U.S. Blues"),
    ("Tuning", "No Such Song"),
    ("Playin' In The Band (reprise)", "Playing in the Band"),
    ("West L A Fadeaway", "West LA Fadeaway"),
    ("Deal >", "Deal"),
    ("St. Stephen", "Saint Stephen"),
    ("Crowd noise and banter", "Bertha"),
    ("It's All Over Now", "It's All Over Now Baby Blue"),
    ("Sugar Magnolia → (Cripe)", "Sugar Magnolia"),
    ("Mississippi Half Step", "Mississippi Half Step Uptown Toodleloo"),
]


def tracks(spark, d):
    """conv_id, turn, title, aligned: turns as tracks of a show, the last ones an encore in every other show."""
    c = t(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = c.join(last, "conv_id").withColumn("i", F.pmod(F.col("conv_id") * 5 + F.col("turn") * 3, F.lit(len(SONGS))).cast("int"))
    aligned = F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") >= F.col("last") - 1), "encore").otherwise("1")
    return rows.join(dealt(spark, SONGS, "title string, closing string"), "i").withColumn("aligned", aligned)


def closers(spark, d):
    """conv_id, k, name, closer: sets close at the middle and the last track; in every fifth show there is an encore besides."""
    rows = tracks(spark, d)
    a = rows.where(F.col("turn") == F.floor(F.col("last") / 2)).select("conv_id", F.lit(1).alias("k"), F.lit("1").alias("name"), F.col("closing").alias("closer"))
    b = rows.where("turn = last").select("conv_id", F.lit(2).alias("k"), F.when(F.col("conv_id") % 5 == 0, "encore").otherwise("2").alias("name"), F.col("closing").alias("closer"))
    return a.unionByName(b)


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({x}), '''', ''), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _looked_up(table: dict, x: str) -> str:
    return f"coalesce(MAP {{{', '.join(f'{literal(k)}: {literal(v)}' for k, v in table.items())}}}[{x}], {x})"


def _plain(x: str) -> str:
    """Normal form without an encore mark."""
    return _norm(rf"regexp_replace(replace({x}, '&', ' and '), '^\s*(?:e|encore)\s*:\s*', '', 'i')")


# each title's songs: names between arrows, then normal forms, then other names, then short names; the last one closes it
LAST = rf"""
names AS (SELECT DISTINCT s, list_filter(list_transform(regexp_split_to_array(s, '->|>|→'), lambda y: trim(regexp_replace(y, '\s*\([^)]*\)\s*$', ''))), lambda y: y <> '') AS n FROM (SELECT title AS s FROM songs UNION SELECT closing FROM songs)),
forms AS (SELECT s, list_filter(list_transform(n, lambda y: {_plain('y')}), lambda y: y <> '') AS f, {_plain('s')} AS whole FROM names),
known AS (SELECT s, list_transform(CASE WHEN len(f) > 0 THEN f ELSE [whole] END, lambda y: {_looked_up(ALIASES, 'y')}) AS f FROM forms),
parts AS (SELECT s, list_transform(f, lambda y: {_looked_up(SHORTHAND, 'y')}) AS p FROM known),
songs AS (SELECT * FROM {values('i, title, closing', [(k, *r) for k, r in enumerate(SONGS)])})"""
LAST = "songs AS" + LAST.rsplit("songs AS", 1)[1] + "," + LAST.rsplit(",\nsongs AS", 1)[0]
TRACKS = f"""{LAST},
c AS (SELECT conv_id, CAST(turn AS INT) AS turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
tracks AS (SELECT c.*, title, closing, p, CASE WHEN conv_id % 2 = 0 AND turn >= last - 1 THEN 'encore' ELSE '1' END AS aligned FROM c JOIN songs ON i = (conv_id * 5 + turn * 3) % {len(SONGS)} JOIN parts ON s = title),
closers AS (SELECT conv_id, 1 AS k, '1' AS name, closing AS closer FROM tracks WHERE turn = last // 2
  UNION ALL SELECT conv_id, 2, CASE WHEN conv_id % 5 = 0 THEN 'encore' ELSE '2' END, closing FROM tracks WHERE turn = last)"""
# how a track's last song answers a closer
CANDIDATES = f"""{TRACKS},
met AS (SELECT c.conv_id, c.k, c.name, c.closer, t.turn, t.p[-1] AS a, q.p[-1] AS b FROM closers c JOIN parts q ON q.s = c.closer JOIN tracks t ON t.conv_id = c.conv_id),
judged AS (SELECT *, a = b AS exact, a = b OR NOT (a IN ('its all over now', 'its all over now baby blue') AND b IN ('its all over now', 'its all over now baby blue')) AND (
  replace(a, ' ', '') = replace(b, ' ', '') OR contains(a, ' ') AND contains(' ' || b || ' ', ' ' || a || ' ') OR contains(b, ' ') AND contains(' ' || a || ' ', ' ' || b || ' ')) AS near FROM met),
candidates AS (SELECT conv_id, k, name, closer, CASE WHEN bool_or(exact) THEN 'exact' WHEN bool_or(near) THEN 'fuzzy' END AS tier,
  CASE WHEN bool_or(exact) THEN list(turn ORDER BY turn) FILTER (WHERE exact) ELSE coalesce(list(turn ORDER BY turn) FILTER (WHERE near), []) END AS options FROM judged GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {TRACKS} SELECT conv_id, turn, array_to_string(p, '|') AS songs FROM tracks")
def title_components(spark, d):
    return tracks(spark, d).select("conv_id", "turn", F.array_join(X.title_parts("title", SHORTHAND), "|").alias("songs"))


@query(f"WITH {CANDIDATES} SELECT conv_id, k, closer, tier, array_to_string(options, ',') AS options FROM candidates")
def closer_candidates(spark, d):
    got = structure.closer_candidates(tracks(spark, d), closers(spark, d), "conv_id", "turn", "title", "closer", "k", "name")
    return got.select("conv_id", "k", "closer", "tier", F.array_join(F.col("options").cast("array<string>"), ",").alias("options"))


@query(f"""WITH {CANDIDATES}, ends AS (SELECT conv_id, turn FROM (SELECT conv_id, turn, aligned, lead(aligned) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM tracks) WHERE nx IS NULL OR nx <> aligned)
SELECT conv_id, k, closer, len(options) AS hits, CASE WHEN len(options) = 0 THEN 'missing' WHEN len(options) > 1 THEN 'ambiguous'
  WHEN (conv_id, options[1]) IN (SELECT (conv_id, turn) FROM ends) THEN 'ok' ELSE 'not at a set break' END AS verdict FROM candidates""")
def closer_contradictions(spark, d):
    return structure.closer_contradictions(tracks(spark, d), closers(spark, d), "conv_id", "turn", "aligned", "title", "closer", "k", "name")


@query(f"""WITH {CANDIDATES}, last_set AS (SELECT conv_id, name, list_max(options) AS e FROM candidates WHERE k = 2),
both_sets AS (SELECT c.conv_id, l.name, e, list_max(list_filter(c.options, lambda x: x < l.e)) AS m FROM candidates c JOIN last_set l USING (conv_id) WHERE c.k = 1),
one AS (SELECT conv_id, m, e, name FROM both_sets WHERE m IS NOT NULL AND e IS NOT NULL),
x AS (SELECT tr.conv_id, turn, CASE WHEN turn <= m THEN '1' ELSE name END AS base, name, m, max(CASE WHEN aligned <> 'encore' THEN turn END) OVER (PARTITION BY tr.conv_id) AS music FROM tracks tr JOIN one USING (conv_id))
SELECT conv_id, turn, CASE WHEN name <> 'encore' AND turn > coalesce(music, -1) AND turn >= m + 2 THEN 'encore' ELSE base END AS anchored FROM x""")
def anchor_breaks(spark, d):
    # of shows with two tracks at least: one track has both closers
    rows, ends = tracks(spark, d), closers(spark, d)
    return structure.anchor_breaks(rows, ends, "conv_id", "turn", "title", "closer", "k", "name", "aligned").select("conv_id", "turn", "anchored")


LABELS = [("Set 1", "1"), ("set one", "1"), ("Set: Two", "2"), ("SET III", "3"), ("First Set", "1"), ("second set (electric)", "2"), (" ii ", "2"), ("3", "3"), ("show", "1"), ("Set", "1"), ("Encore", "encore"), ("Encore 2", "encore"), ("First part", None), ("1st Set", None), ("Set 4", None), ("third", "3"), ("Soundcheck", None), ("", None), (None, None), ("set2:", "2"), ("sets", None), ("settwo", "2"), ("set first", None)]


#: How a label is written around a number n: its shape, and whether it names a set where n is 1, 2 or 3.
LABEL_SHAPES = [("Set {digit}", True), ("SET: {word}", True), ("{ordinal} Set ({kind})", True), (" {roman} ", True), ("set{digit}:", True), ("{ordinal}", True), ("Set {ordinal}", False), ("{kind} {digit}", False), ("{digit} {kind}", False), ("{kind}", False), ("{digit}th set", False), ("{ordinal}set", False)]
NUMBERS = {"digit": list("1234"), "word": ["One", "TWO", "three", "four"], "ordinal": ["First", "second", "THIRD", "Fourth"], "roman": ["i", "II", "iii", "iv"]}


def label_sql() -> str:
    cases = []
    for k, (shape, _) in enumerate(LABEL_SHAPES):
        said = "'" + re.sub(r"\{(\w+)\}", lambda m: "' || event_type || '" if m[1] == "kind" else f"' || {literal(NUMBERS[m[1]])}[n] || '", shape) + "'"
        cases.append(f"WHEN {k} THEN {said}")
    return f"CASE event_id % {len(LABEL_SHAPES)} {' '.join(cases)} END"


@query(f"""WITH e AS (SELECT *, CAST(user_id % 4 + 1 AS INT) AS n FROM events)
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'Encore ' || event_type ELSE {label_sql()} END AS label,
       CASE WHEN event_id % 17 = 0 THEN 'encore' WHEN n < 4 AND event_id % {len(LABEL_SHAPES)} IN ({', '.join(str(k) for k, x in enumerate(LABEL_SHAPES) if x[1])}) THEN CAST(n AS VARCHAR) END AS set_label FROM e""")
def set_labels(spark, d):
    """Labels written in many ways around the numbers and kinds of the events."""
    e = t(spark, d, "events").withColumn("n", (F.col("user_id") % 4).cast("int"))
    said = F.lit(None).cast("string")
    for k, (shape, _) in enumerate(LABEL_SHAPES):
        parts = re.split(r"\{(\w+)\}", shape)
        columns = [F.lit(x) if i % 2 == 0 else F.col("event_type") if x == "kind" else F.get(F.array(*map(F.lit, NUMBERS[x])), F.col("n")) for i, x in enumerate(parts)]
        said = F.when(F.col("event_id") % len(LABEL_SHAPES) == k, F.concat(*columns)).otherwise(said)
    e = e.withColumn("label", F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("Encore "), "event_type")).otherwise(said))
    return e.select("event_id", "label", structure.set_label("label").alias("set_label"))


EVIDENCE = f"""e AS (SELECT event_id, user_id % 7 AS artist, strftime(ts, '%Y-%m-%d') AS date, user_id % 3 AS event, expected AS name, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 50 AS VARCHAR) END AS isong, user_id % 3 AS number
  FROM events JOIN {values('i, label, expected', [(k, *r) for k, r in enumerate(LABELS)])} ON i = event_id % {len(LABELS)}),
g AS (SELECT *, try_cast(isong AS BIGINT) AS pos, 'song ' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS closer FROM e WHERE name IS NOT NULL AND try_cast(isong AS BIGINT) IS NOT NULL),
idx AS (SELECT 'artist' || artist AS artist_key, date, CAST(event AS VARCHAR) AS event, dense_rank() OVER (PARTITION BY artist, date ORDER BY number, event) AS place, row_number() OVER w AS k, name, closer, pos - lag(pos) OVER w AS song_count FROM g WINDOW w AS (PARTITION BY artist, date, event ORDER BY pos, closer))"""


@query(f"WITH {EVIDENCE} SELECT * REPLACE (coalesce(song_count, -1) AS song_count) FROM idx")
def evidence_events(spark, d):
    e = t(spark, d, "events").withColumn("i", (F.col("event_id") % len(LABELS)).cast("int")).join(dealt(spark, LABELS, "label string, expected string"), "i")
    rows = e.select(F.concat(F.lit("The & Artist "), F.col("user_id") % 7).alias("artist"), F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("user_id") % 3).cast("string").alias("event"), "label", F.when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("event_id") % 50).cast("string")).alias("isong"), F.concat(F.lit("song "), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("closer"))
    rows = rows.withColumn("artist", F.replace("artist", F.lit("The & "), F.lit("")))
    return structure.events_of(rows, "artist", "date", "event", "label", "isong", "closer", "event").na.fill(-1, ["song_count"])


#: What a recording's words and description say, and the events of a date with one, two and three of them that it belongs to.
RECORDINGS = [
    ("early show", "Sugaree, Deal", [], [1], [2, 3]),
    ("the LATE show", "Bertha", [1], [2], [1]),
    ("early and late", "", [], [1, 2], []),
    ("one tape", "Me & My Uncle > Bertha", [1], [1], [1]),
    ("one tape", "... Bertha, Sugaree ...", [1], [1, 2], [1, 2]),
    ("lately", "nothing of that", [], [], []),
    ("nearly", "Not Sugar, Ree", [], [], []),
    ("one tape", None, [], [], []),
]


@query(f"SELECT o_orderkey, array_to_string(CASE o_orderkey % 4 WHEN 1 THEN one WHEN 2 THEN two WHEN 3 THEN three ELSE [] END, ',') AS hits FROM (SELECT o_orderkey FROM orders) JOIN {values('i, words, said, one, two, three', [(k, *r) for k, r in enumerate(RECORDINGS)])} ON i = (o_orderkey // 4) % {len(RECORDINGS)}".replace("[]", "CAST([] AS INT[])"))
def assign_events(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", ((F.floor(F.col("o_orderkey") / 4)) % len(RECORDINGS)).cast("int").alias("i"), F.concat(F.lit("day "), F.col("o_orderkey") % 4).alias("date"))
    rows = o.join(dealt(spark, [r[:2] for r in RECORDINGS], "words string, said string"), "i").withColumn("artist", F.lit("My Artist"))
    closing = {1: "Bertha", 2: "Sugaree", 3: "Deal"}
    e = spark.createDataFrame([("myartist", f"day {n}", k, closing[k]) for n in (1, 2, 3) for k in range(1, n + 1)], "artist_key string, date string, place int, closer string")
    return structure.events_of_recordings(rows, e, "o_orderkey", "artist", "date", "words", "said").select("o_orderkey", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"))


#: What stands before and behind a tag's title, and what stays of it; yy and mm are figures of the row.
BEFORE = [("", ""), ("gd{yy}-{mm}-10d1t04 ", ""), ("gd19{yy}-{mm}-10 ", ""), ("phil_{yy}.{mm}.15t02", ""), ("x{yy}-{mm}-08 ", "x{yy}-{mm}-08 "), ("abcdef{yy}-{mm}-08 ", "abcdef{yy}-{mm}-08 "), (" - ", ""), ("19{yy} ", "19{yy} "), ("ab{yy}-{mm}-1d1 ", "ab{yy}-{mm}-1d1 ")]
BEHIND = [("", ""), (".mp3", ""), (".FLAC ", ""), (".wav", ".wav"), (" | ", ""), (" _", ""), (".shn.ogg", ".shn")]


def around(cases, column: int, by: str, divisor: int) -> str:
    filled = lambda x: "'" + x.replace("{yy}", "' || yy || '").replace("{mm}", "' || mm || '") + "'"
    return f"CASE (p_partkey // {divisor}) % {len(cases)} " + " ".join(f"WHEN {k} THEN {filled(x[column])}" for k, x in enumerate(cases)) + " END"


@query(f"""WITH p AS (SELECT *, lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS yy, lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') AS mm FROM part),
c AS (SELECT p_partkey, CASE WHEN p_partkey % 41 = 0 THEN '' ELSE {around(BEFORE, 1, 'p', 1)} || p_name || {around(BEHIND, 1, 'p', 9)} END AS title FROM p)
SELECT p_partkey, title, length(regexp_replace(title, '[^A-Za-z]', '', 'g')) >= 3 AS is_real FROM c""")
def clean_titles(spark, d):
    """Names of parts as titles of tags, with identifiers, extensions and signs around them; some tags are unknown."""
    p = t(spark, d, "part").withColumn("yy", F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")).withColumn("mm", F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"))
    side = lambda cases, column, divisor: F.expr(around(cases, column, "p", divisor).replace("p_partkey // ", "p_partkey div "))
    raw = F.when(F.col("p_partkey") % 41 == 0, " Unknown . ").otherwise(F.concat(side(BEFORE, 0, 1), "p_name", side(BEHIND, 0, 9)))
    return p.select("p_partkey", X.clean_tag(raw).alias("title")).select("p_partkey", "title", X.is_real_title("title").alias("is_real"))


@query("WITH r AS (SELECT l_orderkey, k, CASE WHEN l_orderkey % 3 = 0 AND k > 2 THEN l_returnflag ELSE k || (CASE l_orderkey % 5 WHEN 0 THEN ') ' WHEN 1 THEN '. ' WHEN 2 THEN ' ' WHEN 3 THEN '_' ELSE '-  ' END) || '200 ' || l_returnflag END AS title, l_orderkey % 5 <> 3 AS plain FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_tax, l_discount) AS k FROM lineitem)), n AS (SELECT *, plain AND NOT (l_orderkey % 3 = 0 AND k > 2) AS numbered FROM r), g AS (SELECT *, sum(CAST(numbered AS INT)) OVER w AS a, count(*) OVER w AS b FROM n WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, k, CASE WHEN numbered AND a >= 3 AND a >= 0.8 * b THEN '200 ' || right(title, 1) ELSE title END AS title FROM g")
def strip_numbering(spark, d):
    from stagewise.plans.bindings import lines

    sign = F.element_at(F.array(*map(F.lit, [") ", ". ", " ", "_", "-  "])), (F.col("l_orderkey") % 5 + 1).cast("int"))
    title = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("k") > 2), F.col("l_returnflag")).otherwise(F.concat(F.col("k").cast("string"), sign, F.lit("200 "), F.col("l_returnflag")))
    return files.strip_numbering(lines(spark, d).withColumn("title", title), "l_orderkey", "title").select("l_orderkey", "k", "title")


@query("WITH o AS (SELECT l_orderkey, k, CASE WHEN k % 2 = 1 THEN 'original' ELSE 'derivative' END AS source, 'f' || k AS name, CASE WHEN k % 2 = 0 THEN 'f' || (k - 1) END AS original, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 2 = 1 THEN ' ' || (k * 3) || '/16' ELSE '99' END AS track FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS k FROM lineitem)) SELECT a.l_orderkey, a.k, coalesce(CASE WHEN a.k % 2 = 1 THEN CASE WHEN a.k % 4 <> 3 THEN a.k * 3 END ELSE CASE WHEN a.k % 4 <> 0 THEN (a.k - 1) * 3 END END, -1) AS number FROM o a")
def track_numbers(spark, d):
    from stagewise.plans.bindings import lines

    k = F.col("k")
    f = lambda x: F.concat(F.lit("f"), x.cast("string"))
    track = F.when(k % 4 == 3, F.lit(None).cast("string")).when(k % 2 == 1, F.concat(F.lit(" "), (k * 3).cast("string"), F.lit("/16"))).otherwise("99")
    rows = lines(spark, d).select("l_orderkey", "k", F.when(k % 2 == 1, "original").otherwise("derivative").alias("source"), f(k).alias("name"), F.when(k % 2 == 0, f(k - 1)).alias("original"), track.alias("track"))
    return files.track_numbers(rows, "l_orderkey", name="name", source="source", original="original", track="track").select("l_orderkey", "k", F.coalesce("number", F.lit(-1)).alias("number"))


#: Titles that stand behind a part's name, in turn.
FILLERS = ["", " crowd noise", "/Applause", " tune-up", " Stage repairs", " TUNE  UP", " intros by Phil", " Introspection", " announcement", " talk", " Talkin' Blues", ": Encore  Break", " Encore, Breaks", " encore breakdown", " soundcheck jam", "-outro", " Chattanooga", " Tune", " tuning", "_chat", " annoucement"]


@query(f"""WITH r AS (SELECT p_partkey, p_name || {literal(FILLERS)}[CAST(p_partkey % {len(FILLERS)} + 1 AS INT)] AS title FROM part),
w AS (SELECT *, lower(title) AS s, string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}_]+') AS words FROM r)
SELECT p_partkey, title, len(list_filter({literal(list(FILLER_STEMS))}, lambda x: contains(s, x))) > 0 OR contains(replace(replace(s, ' ', ''), '-', ''), 'tuneup') OR list_has_any(words, {literal(list(FILLER_WORDS))})
  OR contains(' ' || array_to_string(words, ' ') || ' ', ' encore break ') OR contains(' ' || array_to_string(words, ' ') || ' ', ' encore breaks ') AS filler FROM w""")
def filler(spark, d):
    title = F.concat("p_name", F.element_at(F.array(*map(F.lit, FILLERS)), (F.col("p_partkey") % len(FILLERS) + 1).cast("int")))
    return t(spark, d, "part").select("p_partkey", title.alias("title")).select("p_partkey", "title", X.is_filler("title").alias("filler"))


#: What prose asserts of an order: its parts, chains and lists of them with other parts, other parts alone; what is known are the parts of its odd lines.
ASSERTED = f"""{LINES}, parts AS (SELECT list(p_name ORDER BY p_partkey) AS every FROM part),
a AS (SELECT l_orderkey, l_linenumber % 4 AS kind, l_linenumber % 2 = 1 AS sure, every[l_partkey + 1] AS one, every[(l_partkey + k) % len(every) + 1] AS two FROM li, parts),
known AS (SELECT l_orderkey, coalesce(list(DISTINCT one) FILTER (WHERE sure), []) AS names FROM a GROUP BY 1)"""


@query(f"""WITH {ASSERTED}, b AS (
  SELECT l_orderkey, CASE kind WHEN 0 THEN one || ' > ' || two WHEN 1 THEN one WHEN 2 THEN one || ', ' || two ELSE two END AS song,
    NOT ((kind = 3 OR list_contains(names, one)) AND (kind = 1 OR list_contains(names, two))) AS odd
  FROM a JOIN known USING (l_orderkey))
SELECT l_orderkey, count(*) AS asserted, count(*) FILTER (WHERE odd) AS unknown, coalesce(string_agg(song, '; ' ORDER BY song) FILTER (WHERE odd), '') AS names, count(*) FILTER (WHERE odd) >= 2 AND count(*) FILTER (WHERE odd) * 3 > count(*) AS flagged FROM b GROUP BY 1""")
def grounding_flags(spark, d):
    from stagewise.plans.bindings import lines

    part = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("one"))
    n = part.count()
    rows = lines(spark, d).withColumns({"kind": F.col("l_linenumber") % 4, "at": (F.col("l_partkey") + F.col("k")) % n}).join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    rows = rows.join(part.select("p_partkey", F.col("one").alias("two")), F.col("at") == F.col("p_partkey"))
    kind = F.col("kind")
    song = F.when(kind == 0, F.concat_ws(" > ", "one", "two")).when(kind == 1, F.col("one")).when(kind == 2, F.concat_ws(", ", "one", "two")).otherwise(F.col("two"))
    got = guards.grounding_flags(rows.select("l_orderkey", song.alias("song")), rows.where("kind % 2 = 1").select("l_orderkey", "one"), "l_orderkey", "song", "one")
    return got.withColumn("names", F.array_join("names", "; "))


#: What is said behind a document's text, and whether it claims a number of sets.
CLAIMS = [(" They played {} sets that night.", True), (" ({} long sets)", True), (" {} sets of strings", False), (" {} very long sets", False), (" a {}-set show", False), (" co-{} sets!", True), (" {}, sets", False), (" {} sets, of which", True), ("", False)]


@query(f"""WITH r AS (SELECT doc_id, CAST(doc_id // {len(CLAIMS)} % {len(guards.NUMBER_WORDS)} + 1 AS INT) AS k, doc_id % {len(CLAIMS)} AS shape FROM documents)
SELECT doc_id, CASE WHEN shape IN ({', '.join(str(k) for k, x in enumerate(CLAIMS) if x[1])}) THEN CAST({literal(list(guards.NUMBER_WORDS.values()))}[k] AS VARCHAR) ELSE '' END AS claims FROM r""")
def set_count_claims(spark, d):
    """Claims said behind the whole texts of documents, which make none themselves."""
    word = F.element_at(F.array(*map(F.lit, guards.NUMBER_WORDS)), (F.floor(F.col("doc_id") / len(CLAIMS)) % len(guards.NUMBER_WORDS) + 1).cast("int"))
    said = F.lit("")
    for k, (shape, _) in enumerate(CLAIMS):
        said = F.when(F.col("doc_id") % len(CLAIMS) == k, F.replace(F.lit(shape), F.lit("{}"), F.upper(word))).otherwise(said)
    docs = t(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), said).alias("said"))
    return docs.select("doc_id", F.array_join(guards.set_count_claims(F.col("said")).cast("array<string>"), ",").alias("claims"))


@query(f"""WITH {TRACKS}, n AS (SELECT conv_id, turn, title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM tracks),
ok AS (SELECT * FROM n WHERE conv_id % 4 <> 1 AND conv_id % 4 <> 2),
m AS (SELECT *, turn % 3 <> 0 AS matched, NOT regexp_matches(lower(title), 'tuning|crowd|banter') AS song FROM ok)
SELECT conv_id, idx, CASE WHEN turn % 2 = 0 THEN '1' ELSE 'encore' END AS set_label, turn % 2 = 1 AS segue, matched, coalesce(avg(CASE WHEN song THEN CAST(matched AS DOUBLE) END) OVER (PARTITION BY conv_id), 0.0) AS coverage FROM m""")
def applied_alignment(spark, d):
    """Answers leave a track out in every fourth show, and name an unknown set in another."""
    from pyspark.sql import Window

    rows = tracks(spark, d).withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    said = rows.where((F.col("conv_id") % 4 != 1) | (F.col("idx") > 1))
    label = F.when(F.col("conv_id") % 4 == 2, "4").when(F.col("turn") % 2 == 0, "1").otherwise("encore")
    said = said.select("conv_id", "idx", label.alias("label"), (F.col("turn") % 2 == 1).alias("segue"), F.when(F.col("turn") % 3 != 0, F.col("title")).alias("found"))
    got = structure.applied_alignment(rows.select("conv_id", "idx", "title"), said, "conv_id", "idx", "title", "label", "segue", "found")
    return got.select("conv_id", "idx", "set_label", "segue", "matched", "coverage")


@query("""WITH parts AS (SELECT list(p_name ORDER BY p_partkey) AS every FROM part),
x AS (SELECT p_partkey, p_partkey % 6 AS kind, every[p_partkey + 1] AS a, every[(p_partkey * 7 + 3) % len(every) + 1] AS o FROM part, parts),
w AS (SELECT *, string_split(a, ' ') AS u, string_split(o, ' ') AS v FROM x)
SELECT p_partkey, CASE kind WHEN 0 THEN list_has_all(u, v) OR list_has_all(v, u) WHEN 4 THEN u[1][1] || u[2][1] = v[1][1] || v[2][1] WHEN 5 THEN false ELSE true END AS equivalent FROM w""")
def venue_equivalence(spark, d):
    """Names of parts as places against other names, their own words in turn, their initials, a word of theirs, others' initials, and none."""
    part = t(spark, d, "part").select("p_partkey", "p_name")
    n = part.count()
    rows = part.withColumns({"kind": F.col("p_partkey") % 6, "at": (F.col("p_partkey") * 7 + 3) % n})
    rows = rows.join(part.select(F.col("p_partkey").alias("__p"), F.col("p_name").alias("o")), F.col("at") == F.col("__p"))
    kind, words = F.col("kind"), F.split("p_name", " ")
    initials = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)), "")
    b = F.when(kind == 0, F.col("o")).when(kind == 1, F.array_join(F.reverse(words), ", ")).when(kind == 2, F.upper(initials("p_name"))).when(kind == 3, words[0]).when(kind == 4, initials("o"))
    return recovery.venue_mismatches(rows.withColumn("b", b), "p_partkey", "p_name", "b")


#: An order's lines as a setlist: three songs, two songs, the rest an encore; every other song runs into the next of its set.
SETLIST = f"""{LINES}, w AS (SELECT l_orderkey, k, p_name, CASE WHEN k <= 3 THEN '1' WHEN k <= 5 THEN '2' ELSE 'encore' END AS label, l_quantity, lead(p_name) OVER (PARTITION BY l_orderkey ORDER BY k) AS next_name, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY k) AS q, count(*) OVER (PARTITION BY l_orderkey) AS n FROM li JOIN part ON p_partkey = l_partkey),
songs AS (SELECT *, k % 2 = 1 AND k < n AND k NOT IN (3, 5) AS segue FROM w)"""


def setlists(spark, d):
    """l_orderkey, k, p_name, label, segue, l_quantity, n of the orders' setlists."""
    from stagewise.plans.bindings import lines

    k = F.col("k")
    rows = lines(spark, d).join(t(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumns({"label": F.when(k <= 3, "1").when(k <= 5, "2").otherwise("encore"), "n": F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))})
    return rows.withColumn("segue", (k % 2 == 1) & (k < F.col("n")) & ~k.isin(3, 5)).select("l_orderkey", "k", "p_name", "label", "segue", "l_quantity", "n")


@query(f"""WITH {SETLIST}, s AS (SELECT l_orderkey, string_agg(p_name || ' [' || label || ']' || CASE WHEN segue THEN ' >' ELSE '' END, '; ' ORDER BY k) AS songs, count(*) AS n FROM songs GROUP BY 1)
SELECT doc_id, coalesce(songs, '') AS songs, CASE WHEN coalesce(n, 0) < 5 THEN 'low' ELSE 'high' END AS confidence FROM documents LEFT JOIN s ON l_orderkey = doc_id""")
def parse_setlist(spark, d):
    """Setlists that stand behind the whole texts of documents, which are prose without songs, in the ways descriptions are written."""
    song = lambda x: F.concat(x["p_name"], F.when(x["last"], "").when(x["segue"], " > ").otherwise(", "))
    rows = setlists(spark, d).withColumn("last", (F.col("k") == F.col("n")) | F.col("k").isin(3, 5))
    all_of = F.array_sort(F.collect_list(F.struct("k", "p_name", "label", "segue", "last")))
    named = lambda label: F.array_join(F.transform(F.filter("all", lambda x: x["label"] == label), song), "")
    block = lambda head, label: F.when(F.exists("all", lambda x: x["label"] == label), F.concat(F.lit(head), named(label)))
    said = rows.groupBy("l_orderkey").agg(all_of.alias("all")).select("l_orderkey", F.concat_ws("<br>", block("Set 1: ", "1"), block("2nd set - ", "2"), block("E: ", "encore")).alias("list"))
    docs = t(spark, d, "documents").select("doc_id", "text").join(said, F.col("doc_id") == F.col("l_orderkey"), "left")
    got = recovery.parse_setlists(docs.select("doc_id", F.when(F.col("list").isNotNull(), F.concat_ws("\n", "text", "list")).alias("said")), "doc_id", "said")
    line = F.transform("items", lambda x: F.concat(x["title"], F.lit(" ["), x["set"], F.lit("]"), F.when(x["segue"], " >").otherwise("")))
    return got.select("doc_id", F.array_join(line, "; ").alias("songs"), "confidence")


@query(f"""WITH RECURSIVE {SETLIST}, b AS (
  SELECT l_orderkey, list(p_name ORDER BY k) AS items, list(label ORDER BY k) AS labels, list(segue ORDER BY k) AS segues,
    list(CASE WHEN l_quantity > 40 AND next_name IS NOT NULL THEN next_name ELSE p_name END ORDER BY k) FILTER (WHERE l_quantity > 10) AS tracks FROM songs GROUP BY 1),
r AS (
  SELECT *, 0 AS j, 0 AS pos, CAST(NULL AS INT) AS hit, '1' AS label, false AS segue FROM b WHERE tracks IS NOT NULL
  UNION ALL SELECT l_orderkey, items, labels, segues, tracks, j + 1, coalesce(h + 1, pos), h, coalesce(labels[h + 1], label), coalesce(segues[h + 1], false) FROM (
    SELECT *, CASE WHEN p > 0 AND NOT (p > 7 AND len(items) - (pos + p - 1) <= 3 AND len(tracks) - j >= 3) THEN CAST(pos + p - 1 AS INT) END AS h FROM (
      SELECT *, list_position(items[pos + 1 : pos + 9], tracks[j + 1]) AS p FROM r WHERE j < len(tracks)))),
hits AS (SELECT l_orderkey, list(hit) FILTER (WHERE hit IS NOT NULL) AS hits FROM r GROUP BY 1)
SELECT l_orderkey, CAST(j AS BIGINT) AS idx, label AS set_label, segue, hit IS NOT NULL AS matched, round(avg(CAST(hit IS NOT NULL AS INT)) OVER (PARTITION BY l_orderkey), 9) AS coverage,
  array_to_string(list_transform(list_filter(range(len(items)), lambda x: NOT list_contains(coalesce(hits, []), CAST(x AS INT))), lambda x: items[x + 1]), '; ') AS conflicts
FROM r JOIN hits USING (l_orderkey) WHERE j > 0""")
def align_tracks(spark, d):
    """An order's setlist against a tape that lacks some of its songs and takes others out of turn."""
    rows = setlists(spark, d).withColumn("next", F.lead("p_name").over(Window.partitionBy("l_orderkey").orderBy("k")))
    tape = rows.where("l_quantity > 10").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("k")).alias("idx"), F.when((F.col("l_quantity") > 40) & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("p_name")).alias("title"))
    got = recovery.align_tracks(tape, rows, "l_orderkey", "idx", "title", "k", "p_name", "label", "segue")
    return got.select("l_orderkey", "idx", "set_label", "segue", "matched", F.round("coverage", 9).alias("coverage"), F.array_join("conflicts", "; ").alias("conflicts"))


#: Numbers and ordinals that a script says.
COUNTS, PLACES = ["Two", "Three", "Four"], ["second", "third", "fourth"]


@query(f"""WITH {SETLIST}, parts AS (SELECT list(p_name ORDER BY p_partkey) AS every FROM part),
x AS (SELECT l_orderkey AS o, coalesce(list_sort(list(DISTINCT label) FILTER (WHERE label <> 'encore')), []) AS own, list(DISTINCT p_name) AS known, arg_min(p_name, k) AS first FROM songs GROUP BY 1),
y AS (SELECT *, len(own) AS n, [first, every[(o * 5 + 1) % len(every) + 1]] AS said, CASE o % 3 WHEN 0 THEN ['1'] WHEN 1 THEN ['1', '2'] ELSE ['1', 'encore'] END AS intros, o % 3 + 2 AS c, o // 3 % 3 + 2 AS q, {literal(PLACES)}[CAST(o // 3 % 3 + 1 AS INT)] AS place FROM x, parts),
z AS (SELECT *, list_filter(own, lambda s: NOT list_contains(intros, s)) AS missing FROM y)
SELECT o AS l_orderkey, array_to_string(list_transform(list_filter(said, lambda s: NOT list_contains(known, s)), lambda s: 'unknown song: ' || s)
  || list_transform(list_filter(intros, lambda s: NOT list_contains(own, s)), lambda s: 'no such set to introduce: ' || s)
  || CASE WHEN len(missing) > 0 THEN ['no intro of sets: ' || array_to_string(missing, ', ')] ELSE [] END
  || CASE WHEN c <> n THEN ['claims ' || c || ' sets'] ELSE [] END || CASE WHEN q > n THEN ['mentions a ' || place || ' set'] ELSE [] END
  || CASE WHEN o % 5 = 0 THEN list_transform(said, lambda s: 'vague, but names ' || s) || ['vague, but claims ' || c || ' sets', 'vague, but mentions a ' || place || ' set'] ELSE [] END, '; ') AS problems FROM z""")
def script_guard(spark, d):
    """Scripts about orders: a number of sets, an ordinal, the order's first part and another one, and intros that may lack or invent a set."""
    part = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("other"))
    n, o = part.count(), F.col("l_orderkey")
    shows = setlists(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "label", "p_name"))).alias("all")).withColumn("at", (o * 5 + 1) % n).join(part, F.col("at") == F.col("p_partkey"))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % 3 + 1).cast("int"))
    prose = F.concat(pick(COUNTS, o), F.lit(" sets tonight, and the "), pick(PLACES, F.floor(o / 3)), F.lit(" set burns."))
    intros = F.split(pick(["1", "1 2", "1 encore"], o), " ")
    known = F.transform("all", lambda x: x["p_name"])
    problems = guards.script_guard(prose, intros, F.transform("all", lambda x: x["label"]), F.array(known[0], F.col("other")), known, o % 5 == 0)
    return shows.select("l_orderkey", F.array_join(problems, "; ").alias("problems"))


def _files(case: int) -> list[tuple]:
    """(case, name, source, original, format, length, track, title, pos) of a case's files."""
    if case == 0:
        names = ["Bertha", "Sugaree", "Deal", "Drums", "Space", "One More"]
        flac = [(0, f"gd{k:02d}.flac", "original", None, "Flac", "4:00", str(k), x, 2 * k) for k, x in enumerate(names, 1)]
        mp3 = [(0, f"gd{k:02d}.mp3", "derivative", f"gd{k:02d}.flac", "VBR MP3", "4:00", None, f"{k:02d} {x}", 2 * k + 1) for k, x in enumerate(names, 1)]
        return [*flac, *mp3, (0, "spam1.mp3", "original", None, "VBR MP3", "0:29", None, "Buy", 99)]
    if case == 1:
        names = ["Bertha", "Deal", "Ripple", "Althea", "Loser"]
        flac = [(1, f"x{k}.flac", "original", None, "Flac", "300", None, x, 2 * k) for k, x in enumerate(names, 1)]
        return [*flac, *((1, f"x{k}.mp3", "derivative", f"x{k}.flac", "VBR MP3", "5:00", None, None, 2 * k + 1) for k in range(1, 6))]
    return [(case, f"y{k}.mp3", "original", None, "VBR MP3", "0:05:00", None, "unknown", k) for k in range(1, {2: 6, 3: 4}.get(case, 1))]


#: Cases of shows: description, venue, evidence of set ends, the tracks and the flags that come of them.
SHOWS = [
    (
        "My Band<br>Big Hall<br>Set 1: Bertha > Sugaree, Deal<br>Set 2: Drums > Jam<br>Encore: One More",
        "Big Hall",
        [(1, "1", "Sugaree", None), (2, "2", "Space", None), (3, "encore", "One More", None)],
        [("Bertha", "tags", "1", True, "evidence"), ("Sugaree", "tags", "1", False, "evidence"), ("Deal", "tags", "2", False, "evidence"), ("Drums", "tags", "2", True, "evidence"), ("Space", "tags", "2", False, "evidence"), ("One More", "tags", "encore", False, "evidence")],
        [],
    ),
    (
        "Bertha > Deal, Ripple, Althea, Loser",
        "",
        [],
        [("Bertha", "sibling-format", "1", True, "deterministic"), ("Big Deal", "override", "1", False, "deterministic"), ("Ripple", "sibling-format", "1", False, "deterministic"), ("Althea", "sibling-format", "2", False, "deterministic")],
        [],
    ),
    (
        "One, Two Songs, Three Songs, Four Songs, Five Songs",
        "Winterland",
        [(1, "1", "Two Songs", "Fillmore West")],
        [(x, "setlist", "1", False, "evidence") for x in ("One", "Two Songs", "Three Songs", "Four Songs", "Five Songs")],
        ["venue mismatch: Winterland against Fillmore West"],
    ),
    (None, None, [], [("y1.mp3", "unresolved", "1", False, "override"), ("y2.mp3", "unresolved", "2", False, "override"), ("y3.mp3", "unresolved", "encore", False, "override")], ["unresolved track titles", "low-confidence setlist"]),
    ("nothing", "Hall", [], [], ["low-confidence setlist", "no playable tracks"]),
]


def gathered(spark, d):
    """Tracks and flags of shows, one for each conversation, which are dealt the cases."""
    n = len(SHOWS)
    keys = t(spark, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("show"), (F.col("conv_id") % n).cast("int").alias("case"))
    dealt_to = lambda rows, columns: keys.join(F.broadcast(spark.createDataFrame(rows, "case int, " + columns)), "case").drop("case")
    got = dealt_to([x for k in range(n) for x in _files(k)], "name string, source string, original string, format string, length string, track string, title string, pos int")
    descriptions = dealt_to([(k, 0, r[0]) for k, r in enumerate(SHOWS)], "pos int, text string")
    shows = dealt_to([(k, "My Band", r[1], "Town", "1977-05-08") for k, r in enumerate(SHOWS)], "artist string, venue string, city string, date string")
    ends = dealt_to([(k, *x) for k, r in enumerate(SHOWS) for x in r[2]], "k int, name string, closer string, place string")
    song = lambda *names: (None, [(x, None) for x in names])
    service = dealt_to([(1, [song("Bertha", "Big Deal", "Ripple"), song("Althea", "Loser")])], "sets array<struct<encore:int,song:array<struct<name:string,tape:boolean>>>>")
    forced = dealt_to([(1, ["x5.mp3"], {2: "Big Deal"}, None, None, None), (3, None, None, [1], 2, None)], gathering.OVERRIDES.removeprefix("show string, "))
    return gathering.gather(got, descriptions, shows, ends, service=service, overrides=forced)


@query(f"SELECT CAST(conv_id AS VARCHAR) AS show, idx AS index, title, title_source, set_label, segue, alignment FROM (SELECT DISTINCT conv_id FROM conversations) JOIN {values('i, idx, title, title_source, set_label, segue, alignment', [(k, n, *x) for k, r in enumerate(SHOWS) for n, x in enumerate(r[3], 1)])} ON i = conv_id % {len(SHOWS)}")
def gather_tracks(spark, d):
    return gathered(spark, d)[0].select("show", "index", "title", "title_source", "set_label", "segue", "alignment")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS show, flag FROM (SELECT DISTINCT conv_id FROM conversations) JOIN {values('i, flag', [(k, x) for k, r in enumerate(SHOWS) for x in r[4]])} ON i = conv_id % {len(SHOWS)}")
def gather_flags(spark, d):
    return gathered(spark, d)[1].select("show", "flag")


def library(spark, d):
    """Orders as shows: the state by priority."""
    names = F.array(*map(F.lit, ["held", "ready", "packaged", "delivered", "odd"]))
    o = t(spark, d, "orders").withColumn("state", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")))
    return o.select("o_orderkey", "state", F.col("o_orderpriority").alias("artist"), F.col("o_orderstatus").alias("run"))


LIBRARY = "shows AS (SELECT o_orderkey, ['held', 'ready', 'packaged', 'delivered', 'odd'][CAST(o_orderkey % 5 + 1 AS INT)] AS state, o_orderpriority AS artist, o_orderstatus AS run FROM orders)"


@query(f"WITH {LIBRARY} SELECT * FROM shows WHERE state IN ('held', 'packaged') AND contains(lower(artist), 'urgent') AND run = 'F'")
def select_shows(spark, d):
    return shelf.selected(library(spark, d), state="state", artist="artist", run="run", states=["held", "packaged"], artist_like="URGENT", run_is="F")


@query(f"WITH {LIBRARY} SELECT o_orderkey, state = 'held' AS left_out FROM shows")
def split_held(spark, d):
    stay, out = shelf.split_held(library(spark, d), "state")
    return stay.select("o_orderkey", F.lit(False).alias("left_out")).unionByName(out.select("o_orderkey", F.lit(True).alias("left_out")))


@query("WITH k AS (SELECT o_orderkey, list_transform(" + literal(list(catalog.STATES)) + ", lambda x: x)[CAST(o_orderkey % " + str(len(catalog.STATES) + 1) + " + 1 AS INT)] AS state FROM orders) SELECT o_orderkey, state, coalesce(list_position(" + literal(list(catalog.STATES)) + ", state), " + str(len(catalog.STATES) + 1) + ") AS place FROM k")
def status_order(spark, d):
    names = F.array(*map(F.lit, catalog.STATES))
    o = t(spark, d, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % (len(catalog.STATES) + 1)).cast("int")).alias("state"))
    return o.withColumn("place", F.coalesce(shelf.state_order("state"), F.lit(len(catalog.STATES) + 1)))


@query("WITH s AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), b AS (SELECT *, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS best FROM s) SELECT l_orderkey, l_partkey, score, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS rank FROM b WHERE l_partkey <> best")
def considered_recordings(spark, d):
    s = t(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("score"))
    best = s.groupBy("l_orderkey").agg(F.min(F.struct(-F.col("score"), "l_partkey"))["l_partkey"].alias("best"))
    return shelf.considered(s.join(best, "l_orderkey"), "l_orderkey", "l_partkey", "best", "score").select("l_orderkey", "l_partkey", "score", "rank")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def catalog_depth(spark, d):
    return shelf.deepest(t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n", "o_custkey", 10)


@query("WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_tax, l_discount) AS k FROM lineitem), q AS (SELECT l_orderkey, unnest(['2', 'a.flac', '99']) AS token FROM l WHERE k = 1) SELECT q.l_orderkey, token, CASE WHEN token = 'a.flac' THEN token ELSE 'f' || l.l_partkey END AS filename FROM q LEFT JOIN l ON l.l_orderkey = q.l_orderkey AND l.k = try_cast(token AS INT)")
def exclude_tokens(spark, d):
    from stagewise.plans.bindings import lines

    rows = lines(spark, d).withColumn("file", F.concat(F.lit("f"), F.col("l_partkey").cast("string")))
    said = rows.where("k = 1").select("l_orderkey", F.lit(" 2, a.flac,, 99 ").alias("token"))
    return shelf.excluded_files(said, rows, "l_orderkey", "token", "k", "file")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Ann' WHEN 'MACHINERY' THEN 'Bob' ELSE 'Cy' END AS presenter, CASE c_mktsegment WHEN 'BUILDING' THEN 'Hour' END AS title FROM customer")
def assign_presenter(spark, d):
    a = spark.createDataFrame([("BUILDING", "Ann", "Hour"), ("MACHINERY", "Bob", None), ("GHOST", "Dan", "No")], "c_mktsegment string, who string, what string")
    return shelf.assigned(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), a, "c_mktsegment", "who", "what", "Cy").select("c_custkey", "presenter", "title")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def referential_guard(spark, d):
    return shelf.in_use(t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")), t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(event_type, ',' ORDER BY event_id) AS events FROM events GROUP BY 1, 2) SELECT c_custkey, coalesce(events, '') AS events FROM customer LEFT JOIN e ON user_id = c_custkey AND day = '2024-01-02'")
def events_lookup(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type")
    c = t(spark, d, "customer").select("c_custkey", F.lit("2024-01-02").alias("day"))
    return shelf.events_at(c, e, ["c_custkey", "day"], "event_id", "event_type").select("c_custkey", F.array_join("events", ",").alias("events"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_linenumber % 2 = 0 AND trim(p_name) <> '' THEN p_name END, CASE WHEN l_linenumber % 3 = 0 THEN 'said' END, 'file' || l_linenumber) AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_linenumber % 2 = 0")
def manifest_titles(spark, d):
    entries = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("p_partkey"), F.when(F.col("l_linenumber") % 3 == 0, "said").otherwise(" ").alias("said"), F.concat(F.lit("file"), F.col("l_linenumber").cast("string")).alias("file"))
    return shelf.titles_by_cascade(entries, t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "said", "file").select("l_orderkey", "l_linenumber", "l_partkey", "title")


@query("WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN c_name END AS venue, c_mktsegment AS city, CASE WHEN c_custkey % 4 > 0 THEN 'known' END AS kv, CASE WHEN c_custkey % 7 = 0 THEN 'forced' END AS f FROM customer), y AS (SELECT *, trim(coalesce(venue, '')) = '' AND kv IS NOT NULL AS filled FROM x) SELECT k, coalesce(f, CASE WHEN filled THEN kv ELSE venue END) AS venue, CASE WHEN filled THEN 'there' ELSE city END AS city, CASE WHEN f IS NOT NULL THEN 'override' WHEN filled THEN 'evidence' ELSE 'item' END AS venue_source FROM y")
def venue_enrichment(spark, d):
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(k.alias("k"), F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("c_name")).alias("venue"), F.col("c_mktsegment").alias("city"), F.when(k % 4 > 0, "known").alias("kv"), F.lit("there").alias("kc"), F.when(k % 7 == 0, "forced").alias("f"))
    return shelf.place_of(rows, "venue", "city", "kv", "kc", "f").select("k", "venue", "city", "venue_source")


@query("SELECT o_custkey, CAST(max(epoch_us(o_orderdate)) AS BIGINT) AS latest_us FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def retained_max(spark, d):
    return t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("latest_us"))


@query("SELECT conv_id, batch, string_agg(b, chr(10) || chr(10) ORDER BY n) AS text FROM (SELECT conv_id, n, n // 10 AS batch, substr(coalesce(text, ''), 1, 1500) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)) GROUP BY 1, 2")
def review_prompts(spark, d):
    return manifest.review_prompts(t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def inventory_semi_join(spark, d):
    return catalog.in_inventory(t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


#: Ways to write an order's date, in the pattern letters of Spark and of SQL, and what is read: all of it (d), month and day (m), nothing.
SPELLINGS = [
    ("yyyy-M-d", "%Y-%-m-%-d", "d"),
    ("M/d/yy", "%-m/%-d/%y", "d"),
    ("M/d/yyyy", "%-m/%-d/%Y", "d"),
    ("EEEE, MMMM d, yyyy", "%A, %B %-d, %Y", "d"),
    ("EEE. MMM d ''yy", "%a. %b %-d '%y", "d"),
    ("d MMMM yyyy", "%-d %B %Y", "d"),
    ("MMMM d", "%B %-d", "m"),
    ("d MMM.", "%-d %b.", "m"),
    ("M/d", "%-m/%-d", "m"),
    ("'the' d 'of' MMMM", "the %-d of %B", ""),
    ("yyyy", "%Y", ""),
]


@query(f"""WITH k AS (SELECT *, o_orderkey % {len(SPELLINGS)} AS shape FROM orders)
SELECT o_orderkey, CASE shape {' '.join(f"WHEN {k} THEN strftime(o_orderdate, {literal(sql)})" for k, (_, sql, _) in enumerate(SPELLINGS))} END AS said,
  CASE {literal([r for *_, r in SPELLINGS])}[CAST(shape + 1 AS INT)] WHEN 'd' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'm' THEN strftime(o_orderdate, '--%m-%d') END AS date FROM k""")
def date_spellings(spark, d):
    day = F.col("o_orderdate").cast("timestamp")
    said = F.lit(None).cast("string")
    for k, (pattern, *_) in enumerate(SPELLINGS):
        said = F.when(F.col("o_orderkey") % len(SPELLINGS) == k, F.date_format(day, pattern)).otherwise(said)
    return t(spark, d, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", "said", X.normalize_date("said").alias("date"))
