"""The catalog's operators bound to the test tables, each with SQL that gives the same rows.

An item is an order, its files are the order's lines, an artist a customer, a performance a customer and
month, the ledger the events, tracks the turns of conversations, reviews and descriptions the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions import text as X
from stagewise.operators import catalog, census, files, guards, manifest, ranking, structure
from stagewise.plans.registry import literal, query, t


def items(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.count(F.lit(1)).alias("reviews"), (F.avg("l_quantity") / 10).alias("rating"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("artist"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").cast("long").alias("downloads"))
    return o.join(lines, "item", "left").na.fill(0, ["reviews"])


ITEMS = """items AS (
  SELECT o_orderkey AS item, o_custkey AS artist, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m') AS month,
         strftime(o_orderdate, '%Y') AS year, o_orderpriority AS title, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS downloads,
         coalesce(l.reviews, 0) AS reviews, l.rating
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS reviews, avg(l_quantity) / 10 AS rating FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""


def performances(spark: SparkSession, d: str) -> DataFrame:
    agg = items(spark, d).groupBy("artist", "month").agg(F.sum("reviews").alias("reviews"), F.coalesce(F.max("rating"), F.lit(0.0)).alias("rating"), F.count(F.lit(1)).alias("recordings"))
    return agg.withColumn("performance_id", F.concat_ws("/", F.col("artist").cast("string"), "month"))


PERFORMANCES = (
    ITEMS
    + """, performances AS (
  SELECT artist, month, CAST(sum(reviews) AS BIGINT) AS reviews, coalesce(max(rating), 0.0) AS rating, count(*) AS recordings,
         artist || '/' || month AS performance_id FROM items GROUP BY artist, month)"""
)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with k, their place in the order: line numbers repeat."""
    by = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_tax", "l_discount")]
    return ranking.ranked(t(spark, d, "lineitem"), ["l_orderkey"], by, "k")


LINES = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_tax, l_discount) AS k FROM lineitem)"


def evidence() -> list:
    return [F.col("reviews").desc(), F.col("rating").desc(), F.col("performance_id")]


@query(f"WITH {PERFORMANCES}, ok AS (SELECT * FROM performances WHERE rating >= 2.5 AND reviews >= 3 AND artist NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')), r AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY reviews DESC, rating DESC, performance_id) AS k FROM ok), p AS (SELECT *, row_number() OVER (ORDER BY k > 4, reviews DESC, rating DESC, performance_id) AS pick FROM r) SELECT performance_id, artist, month, reviews, rating, pick FROM p WHERE pick <= 12")
def performance_shortlist(spark, d):
    bought = t(spark, d, "events").where("event_type = 'purchase'").select("user_id")
    fresh = catalog.not_in_history(performances(spark, d), "artist", bought)
    ok = fresh.where("rating >= 2.5 and reviews >= 3")
    return ranking.capped_pick(ok, "artist", evidence(), 12, 1 / 3).select("performance_id", "artist", "month", "reviews", "rating", "pick")


INDEX = f"{ITEMS}, idx AS (SELECT c_custkey AS artist, c_name AS title, count(item) AS recordings, CAST(coalesce(sum(downloads), 0) AS BIGINT) AS downloads, min(year) AS year_min, max(year) AS year_max FROM customer LEFT JOIN items ON artist = c_custkey GROUP BY 1, 2)"


def index(spark, d):
    artists = t(spark, d, "customer").select(F.col("c_custkey").alias("artist"), F.col("c_name").alias("title"))
    return catalog.artist_index(artists, items(spark, d), "artist", "artist", "year", "downloads")


@query(f"WITH {INDEX} SELECT * FROM idx")
def artist_index(spark, d):
    return index(spark, d)


@query(f"WITH {INDEX} SELECT * FROM idx WHERE recordings >= 12 OR downloads >= 3000000")
def artist_gate(spark, d):
    return catalog.artist_gate(index(spark, d), 12, 3_000_000)


ASKED = ["customer#000000012", "00000099", "nobody", "#00000003"]


@query("WITH q AS (SELECT unnest(['customer#000000012', '00000099', 'nobody', '#00000003']) AS asked), h AS (SELECT asked, c_name, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS c, regexp_replace(lower(asked), '[^a-z0-9]', '', 'g') AS a FROM q, customer), g AS (SELECT asked, count(*) AS n, min(CASE WHEN c = a THEN c_name END) AS ex, min(c_name) AS one FROM h WHERE contains(c, a) GROUP BY asked) SELECT asked, coalesce(ex, CASE WHEN n = 1 THEN one END) AS resolved, coalesce(n, 0) AS n_options FROM q LEFT JOIN g USING (asked)")
def artist_resolve(spark, d):
    return catalog.resolve_names(spark.createDataFrame([(a,) for a in ASKED], "q string"), t(spark, d, "customer"), "q", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase') OR CAST(c_custkey AS VARCHAR) IN ('1', '2')")
def family_artists(spark, d):
    a = t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("k"))
    e = t(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("k"))
    return catalog.family_artists(a, "k", e, "k", ["1", "2"]).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '2100-01-01'")
def search_filter(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return catalog.search_filter(o, "o_orderstatus", "o_custkey", "date", in_collection="F", date_from="1995-01-01").select("o_orderkey", "o_custkey", "date")


@query(f"WITH {ITEMS} SELECT artist || '/' || month AS performance_id, count(*) AS recordings, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items FROM items GROUP BY artist, month")
def group_performances(spark, d):
    agg = items(spark, d).groupBy("artist", "month").agg(F.count(F.lit(1)).alias("recordings"), F.array_sort(F.collect_list("item")).alias("i"))
    return agg.select(F.concat_ws("/", F.col("artist").cast("string"), "month").alias("performance_id"), "recordings", F.array_join(F.col("i").cast("array<string>"), ",").alias("items"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS votes, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, f) AS k FROM c) SELECT o_custkey, o_orderpriority, votes FROM r WHERE k = 1")
def majority_vote(spark, d):
    return ranking.majority(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query(f"WITH {PERFORMANCES} SELECT performance_id, reviews, rating FROM performances WHERE rating >= 3.0 AND reviews >= 4")
def mechanical_gate(spark, d):
    return performances(spark, d).where("rating >= 3.0 and reviews >= 4").select("performance_id", "reviews", "rating")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'click') AND user_id IS NOT NULL)")
def history_anti_join(spark, d):
    e = t(spark, d, "events")
    return catalog.not_in_history(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", *[e.where(F.col("event_type") == k).select("user_id") for k in ("purchase", "click")])


NORM = "trim(regexp_replace(regexp_replace(replace(lower({0}), '''', ''), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
# tails behind each hit, by position
SEQ = f"n AS (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS h FROM documents WHERE text IS NOT NULL), s1 AS (SELECT doc_id, CASE WHEN strpos(h, ' the ') > 0 THEN substr(h, strpos(h, ' the ') + 4) END AS h FROM n), s2 AS (SELECT doc_id, CASE WHEN strpos(h, ' of ') > 0 THEN substr(h, strpos(h, ' of ') + 3) END AS h FROM s1), s3 AS (SELECT doc_id, CASE WHEN strpos(h, ' that ') > 0 THEN substr(h, strpos(h, ' that ') + 5) END AS h FROM s2)"


@query(f"WITH {SEQ} SELECT doc_id FROM s3 WHERE h IS NOT NULL")
def song_sequence_contains(spark, d):
    docs = t(spark, d, "documents").where("text is not null")
    return docs.where(X.contains_sequence(X.normalize_title("text"), ["the", "of", "that"])).select("doc_id")


@query(f"WITH {PERFORMANCES} SELECT performance_id, substr(month, 1, 4) AS year, reviews, rating, row_number() OVER (PARTITION BY substr(month, 1, 4) ORDER BY reviews DESC, rating DESC, performance_id) AS rank FROM performances")
def evidence_rank(spark, d):
    p = performances(spark, d).select("performance_id", F.substring("month", 1, 4).alias("year"), "reviews", "rating")
    return ranking.ranked(p, ["year"], evidence())


@query(f"WITH {PERFORMANCES}, r AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY reviews DESC, rating DESC, performance_id) AS k FROM performances), p AS (SELECT *, row_number() OVER (ORDER BY k > 2, reviews DESC, rating DESC, performance_id) AS pick FROM r) SELECT performance_id, reviews, rating, pick FROM p WHERE pick <= 40")
def capped_pick(spark, d):
    return ranking.capped_pick(performances(spark, d), "artist", evidence(), 40, 0.05).select("performance_id", "reviews", "rating", "pick")


@query(f"""WITH {PERFORMANCES}, a AS (SELECT *, -reviews AS o1, -rating AS o2, substr(month, 1, 4) AS year FROM performances),
 b AS (SELECT *, count(*) OVER (PARTITION BY artist) AS n, row_number() OVER (PARTITION BY artist ORDER BY o1, o2, performance_id) AS slot, row_number() OVER (PARTITION BY artist, year ORDER BY o1, o2, performance_id) AS iny FROM a),
 c AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY iny > greatest(1, ceil(n * 0.25)), o1, o2, performance_id) AS q FROM b),
 s AS (SELECT artist, slot, o1, o2, performance_id AS pid FROM c WHERE slot <= 3),
 e AS (SELECT c.performance_id, c.reviews, c.rating, s.slot IS NULL AS late, coalesce(s.o1, c.o1) AS k1, CASE WHEN s.slot IS NULL THEN c.o2 ELSE s.o2 END AS k2, coalesce(s.pid, c.performance_id) AS k3 FROM c LEFT JOIN s ON s.artist = c.artist AND s.slot = c.q),
 f AS (SELECT *, row_number() OVER (ORDER BY late, k1, k2, k3) AS pick FROM e) SELECT performance_id, reviews, rating, pick FROM f WHERE pick <= 60""")
def capped_pick_two_axis(spark, d):
    p = performances(spark, d).withColumns({"o1": -F.col("reviews"), "o2": -F.col("rating"), "year": F.substring("month", 1, 4)})
    return ranking.capped_pick_two_axes(p, "artist", "year", ["o1", "o2", "performance_id"], 60, 0.05, 0.25).select("performance_id", "reviews", "rating", "pick")


@query("SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE quality >= 1")
def quality_floor(spark, d):
    labels = t(spark, d, "labels")
    return catalog.quality_floor(t(spark, d, "documents").select("doc_id", "source"), labels, "doc_id", "quality", 1, "toxic").select("doc_id", "source", "quality")


@query("SELECT doc_id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) // 5 AS batch FROM labels")
def review_batches(spark, d):
    return ranking.batches(t(spark, d, "labels").select("doc_id", "toxic"), ["toxic"], [F.col("doc_id")], 5)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, coalesce(string_agg(substr(text, 1, 800), chr(10) || chr(10) ORDER BY n), '') AS digest FROM r WHERE n <= 5 GROUP BY conv_id")
def review_digest(spark, d):
    return manifest.review_digest(t(spark, d, "conversations"), "conv_id", "turn", "text")


#: What a text says of its source, one more for each document in turn.
SOURCES = ["", " mtx of two tapes", " schoeps mk4 > dat", " the audience tape", " audiences", " AUD", " auditorium", " SBD>dat", " sbdx", " Soundboards", " premtx", " dematrixed"]


@query(f"""WITH s AS (SELECT doc_id, lower(concat_ws(' ', source, text) || {literal(SOURCES)}[CAST(doc_id % {len(SOURCES)} + 1 AS INT)]) AS s FROM documents),
w AS (SELECT doc_id, s, string_split_regex(s, '[^\\p{{L}}\\p{{N}}_]+') AS words FROM s)
SELECT doc_id, CASE WHEN contains(s, 'matrix') OR list_contains(words, 'mtx') THEN 'matrix' WHEN contains(s, 'soundboard') OR list_contains(words, 'sbd') THEN 'sbd'
  WHEN list_has_any(words, ['aud', 'audience']) THEN 'aud' ELSE 'unknown' END AS lineage FROM w""")
def lineage_class(spark, d):
    more = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("doc_id") % len(SOURCES) + 1).cast("int"))
    docs = t(spark, d, "documents").withColumn("text", F.concat(F.coalesce("text", F.lit("")), more))
    return docs.select("doc_id", X.lineage_class("source", "text").alias("lineage"))


@query("WITH h AS (SELECT p_partkey, p_brand, p_size, contains(lower(p_type), 'brass') AS a, contains(lower(p_type), 'steel') AS b FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, a ORDER BY p_size DESC, p_partkey) AS ka, row_number() OVER (PARTITION BY p_brand, b ORDER BY p_size DESC, p_partkey) AS kb FROM h) SELECT p_partkey, p_brand, greatest(CASE WHEN a THEN CASE WHEN ka = 1 THEN 2.0 ELSE 1.0 END ELSE 0.0 END, CASE WHEN b THEN CASE WHEN kb = 1 THEN 1.0 ELSE 0.5 END ELSE 0.0 END)::DOUBLE AS bonus FROM r")
def pattern_bonus(spark, d):
    rows = t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return files.pattern_bonus(rows, "p_brand", "p_type", [F.col("p_size").desc(), F.col("p_partkey")], {"brass": 2.0, "steel": 1.0}).select("p_partkey", "p_brand", "bonus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND s BETWEEN '1992-01-01' AND '1993-12-31' THEN 'early' WHEN o_orderstatus = 'F' AND s BETWEEN '1993-06-01' AND '1994-12-31' THEN 'late' WHEN o_orderstatus = 'O' AND s BETWEEN '1996-01-01' AND '2100-01-01' THEN 'open' END AS era FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders)")
def era_override(spark, d):
    o = t(spark, d, "orders").withColumn("s", F.date_format("o_orderdate", "yyyy-MM-dd"))
    eras = [("early", "F", "1992-01-01", "1993-12-31"), ("late", "F", "1993-06-01", "1994-12-31"), ("open", "O", "1996-01-01", "2100-01-01")]
    return o.select("o_orderkey", files.era_override(o, "o_orderstatus", "s", eras).alias("era"))


SCORED = f"""{ITEMS}, k AS (SELECT *, CASE status WHEN 'F' THEN 'sbd' WHEN 'O' THEN 'aud' ELSE 'other' END AS lineage, max(ln(1 + downloads)) OVER (PARTITION BY artist, month) AS md, max(reviews) OVER (PARTITION BY artist, month) AS mr FROM items),
 scored AS (SELECT item, artist, month, round(((CASE lineage WHEN 'sbd' THEN 3.0 WHEN 'aud' THEN 1.0 ELSE 0.0 END)::DOUBLE + coalesce(rating, 0.0) * log10(1 + reviews) + 0.75 * (CASE WHEN md > 0 THEN ln(1 + downloads) / md ELSE 0 END) + CASE WHEN title LIKE '1%' THEN 0.5 ELSE 0.0 END) * (0.5 + 0.5 * (CASE WHEN mr > 0 THEN reviews / mr ELSE 0 END)) - 0.5 * least(CASE WHEN title LIKE '5%' THEN 1 ELSE 0 END, 4), 6) AS score FROM k)"""


def scored(spark, d):
    rows = files.sibling_shares(items(spark, d).withColumn("perf", F.concat_ws("/", F.col("artist").cast("string"), "month")), "perf", "downloads", "reviews")
    lineage = F.when(F.col("status") == "F", "sbd").when(F.col("status") == "O", "aud").otherwise("other")
    s = files.recording_score(lineage=lineage, rating=F.col("rating"), reviews=F.col("reviews"), wanted_format=F.col("title").startswith("1"), completeness=F.col("completeness"), complaints=F.when(F.col("title").startswith("5"), 1).otherwise(0), downloads_share=F.col("downloads_share"))
    return rows.select("item", "artist", "month", F.round(s, 6).alias("score"))


@query(f"WITH {SCORED} SELECT * FROM scored")
def score_recording(spark, d):
    return scored(spark, d)


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY artist, month ORDER BY score DESC, item) AS k FROM scored) SELECT item, artist, month, score FROM r WHERE k = 1")
def chosen_recording(spark, d):
    return ranking.argfirst(scored(spark, d), ["artist", "month"], [F.col("score").desc(), F.col("item")])


@query("SELECT l_orderkey, count(l_quantity) AS n, (CASE WHEN count(l_quantity) >= 5 THEN median(l_quantity) * 0.25 ELSE 90.0 END)::DOUBLE AS floor_sec FROM lineitem GROUP BY 1")
def duration_floor(spark, d):
    return files.duration_floor(t(spark, d, "lineitem"), "l_orderkey", "l_quantity")


FILES = """f AS (SELECT l_orderkey AS item, l_linenumber AS n, l_returnflag AS stem, CASE l_linestatus WHEN 'O' THEN 'original' ELSE 'derivative' END AS source, l_returnflag || l_linenumber AS name, l_returnflag || (l_linenumber - 1) AS original, l_quantity * 10 AS secs FROM lineitem),
 g AS (SELECT *, count(*) OVER (PARTITION BY item, stem) AS c, min(n) OVER (PARTITION BY item, stem) AS p, list(CASE WHEN source = 'original' THEN name END) OVER (PARTITION BY item) AS names FROM f),
 h AS (SELECT *, first_value(stem) OVER (PARTITION BY item ORDER BY c DESC, p, stem) AS dom FROM g),
 i AS (SELECT *, CASE WHEN source = 'derivative' AND NOT list_contains(names, original) THEN 'derivative of unknown original' END AS r1, CASE WHEN stem <> dom THEN 'filename convention mismatch' END AS r2 FROM h),
 j AS (SELECT *, count(CASE WHEN r1 IS NULL AND r2 IS NULL THEN secs END) OVER (PARTITION BY item) AS k, median(CASE WHEN r1 IS NULL AND r2 IS NULL THEN secs END) OVER (PARTITION BY item) AS m FROM i),
 junk AS (SELECT item, n, stem, name, source, secs, concat_ws('; ', r1, r2, CASE WHEN secs IS NULL THEN 'missing duration' WHEN secs < CASE WHEN k >= 5 THEN m * 0.25 ELSE 90.0 END THEN 'implausibly short' END) AS reasons FROM j)"""


def item_files(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("stem"), F.when(F.col("l_linestatus") == "O", "original").otherwise("derivative").alias("source"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name"), F.concat("l_returnflag", (F.col("l_linenumber") - 1).cast("string")).alias("original"), (F.col("l_quantity") * 10).alias("secs"))


def junked(spark, d):
    return files.junk_filter(item_files(spark, d), "item", name="name", stem="stem", source="source", original="original", seconds="secs", position="n")


@query(f"WITH {FILES} SELECT item, n, name, reasons, reasons = '' AS kept FROM junk")
def junk_filter(spark, d):
    return junked(spark, d).select("item", "n", "name", F.array_join("reasons", "; ").alias("reasons"), (F.size("reasons") == 0).alias("kept"))


@query(f"WITH {FILES}, b AS (SELECT item, stem, count(*) FILTER (WHERE reasons = '') AS n_kept, count(*) AS n_files FROM junk WHERE stem IN ('R', 'A', 'N') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n_kept = 0, list_position(['R', 'A', 'N'], stem)) AS k FROM b) SELECT item, stem, n_kept, n_files FROM r WHERE k = 1")
def format_preference(spark, d):
    return files.format_preference(junked(spark, d), "item", "stem", F.size("reasons") == 0, ["R", "A", "N"])


@query(f"WITH {LINES}, f AS (SELECT l_orderkey AS item, k, l_suppkey % 40 AS track, l_returnflag || k AS name FROM li), g AS (SELECT *, count(*) OVER (PARTITION BY item) = count(DISTINCT track) OVER (PARTITION BY item) AS ok, row_number() OVER (PARTITION BY item ORDER BY name) AS byname FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN ok THEN track END, name) AS position FROM g) SELECT item, k, position, max(CAST(byname <> position AS INT)) OVER (PARTITION BY item) = 1 AS reordered FROM h")
def play_order(spark, d):
    rows = lines(spark, d).select(F.col("l_orderkey").alias("item"), "k", (F.col("l_suppkey") % 40).alias("track"), F.concat("l_returnflag", F.col("k").cast("string")).alias("name"))
    return files.play_order(rows, "item", "track", "name").select("item", "k", "position", "reordered")


@query("SELECT p_brand, count(*) FILTER (WHERE length(regexp_replace(coalesce(p_name, ''), '[^A-Za-z]', '', 'g')) >= 3) AS n_real, count(*) AS n, avg(CASE WHEN length(regexp_replace(coalesce(p_name, ''), '[^A-Za-z]', '', 'g')) >= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS fraction FROM part GROUP BY 1")
def title_fraction(spark, d):
    return files.title_fraction(t(spark, d, "part"), "p_brand", "p_name")


@query("WITH a AS (SELECT l_orderkey, l_returnflag, count(*) AS a FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_returnflag, count(*) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) SELECT l_orderkey, CAST(sum(coalesce(a, 0)) AS BIGINT) AS n_a, CAST(sum(coalesce(b, 0)) AS BIGINT) AS n_b, bool_and(coalesce(a, 0) = 1 AND coalesce(b, 0) = 1) AS matched FROM a FULL JOIN b USING (l_orderkey, l_returnflag) GROUP BY 1")
def sibling_bijection(spark, d):
    rows = t(spark, d, "lineitem")
    return files.sibling_bijection(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), "l_orderkey", "l_returnflag")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN p_name END AS a, CASE WHEN l_linenumber % 3 = 0 THEN p_type ELSE '12' END AS b, 'track' || l_linenumber AS f FROM lineitem LEFT JOIN part ON p_partkey = l_partkey), x AS (SELECT *, length(regexp_replace(coalesce(a, ''), '[^A-Za-z]', '', 'g')) >= 3 AS ra, length(regexp_replace(coalesce(b, ''), '[^A-Za-z]', '', 'g')) >= 3 AS rb FROM r) SELECT l_orderkey, l_linenumber, CASE WHEN ra THEN a WHEN rb THEN b ELSE f END AS title, CASE WHEN ra THEN 'tag' WHEN rb THEN 'setlist' ELSE 'unresolved' END AS title_source FROM x")
def resolve_titles(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    tag, listed = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")), F.when(F.col("l_linenumber") % 3 == 0, F.col("p_type")).otherwise("12")
    fallback = F.concat(F.lit("track"), F.col("l_linenumber").cast("string"))
    return files.resolve_titles(rows, [("tag", tag), ("setlist", listed)], fallback).select("l_orderkey", "l_linenumber", "title", "title_source")


@query(f"WITH {LINES}, a AS (SELECT l_orderkey, k, l_returnflag, l_tax > 0.05 AS segue, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY k) AS n FROM li WHERE l_linestatus = 'O'), b AS (SELECT l_orderkey, l_returnflag, l_tax > 0.05 AS segue, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY k) AS n FROM li WHERE l_linestatus = 'F') SELECT a.l_orderkey, a.k, a.segue, a.segue OR coalesce(b.segue, false) AS blended FROM a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.n = b.n")
def segue_blend(spark, d):
    rows = lines(spark, d).withColumn("segue", F.col("l_tax") > 0.05)
    return structure.segue_blend(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), "l_orderkey", "l_returnflag", "k", "segue").select("l_orderkey", "k", "segue", "blended")


@query("WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) SELECT conv_id, turn AS after_track FROM n WHERE nx <> role")
def set_breaks(spark, d):
    return structure.set_breaks(t(spark, d, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, CASE WHEN turn > 5 THEN 'encore' ELSE CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS VARCHAR) END AS set_label FROM conversations")
def labels_from_breaks(spark, d):
    c = t(spark, d, "conversations")
    return structure.labels_from_breaks(c, "conv_id", "turn", F.col("role") == "assistant", F.lit(5)).select("conv_id", "turn", "set_label")


@query("SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS song_count FROM events")
def evidence_index(spark, d):
    return structure.evidence_index(t(spark, d, "events"), ["user_id"], "event_id", "value").select("event_id", "user_id", "song_count")


@query("SELECT doc_id, concat_ws('/', concat_ws('/', source, lang), CASE n WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN e AND l THEN 'spans' WHEN e THEN 'e1' WHEN l THEN 'e2' WHEN h IS NOT NULL THEN 'e' || h ELSE 'unassigned' END WHEN 3 THEN CASE WHEN h IS NOT NULL THEN 'e' || h ELSE 'unassigned' END ELSE CASE WHEN e AND NOT l THEN 'early' WHEN l AND NOT e THEN 'late' END END) AS performance_id FROM (SELECT *, doc_id % 4 AS n, regexp_matches(lower(text), '\\bthe\\b') AS e, regexp_matches(lower(text), '\\bwas\\b') AS l, CASE WHEN doc_id % 5 < 2 THEN doc_id % 5 + 1 END AS h FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents))")
def event_partition(spark, d):
    docs = t(spark, d, "documents")
    # the words early and late of the operator, as words of these texts
    said = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\b(early|late)\b", " "), r"\bthe\b", "early")
    said = F.regexp_replace(said, r"\bwas\b", "late")
    n = (F.col("doc_id") % 4).cast("int")
    hit = F.when(F.col("doc_id") % 5 < 2, F.col("doc_id") % 5 + 1)
    return docs.select("doc_id", structure.event_partition(docs, F.col("source"), F.col("lang"), n, said, hit).alias("performance_id"))


@query("WITH p AS (SELECT doc_id, source, n_chars // 400 AS len, CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' ELSE 'low' END AS conf, lang = 'en' AS off, n_chars % 2 = 0 AS multi, 12 AS target FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off DESC, len >= least(target, greatest(5, target // 2)) DESC, CASE conf WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, multi DESC, abs(len - target), doc_id) AS k FROM p) SELECT source, doc_id, len FROM r WHERE k = 1")
def parse_rank(spark, d):
    conf = F.when(F.col("n_chars") > 4000, "high").when(F.col("n_chars") > 1000, "medium").otherwise("low")
    p = t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.floor(F.col("n_chars") / 400).cast("long").alias("len"), conf.alias("conf"), F.lit(12).alias("target"))
    return structure.parse_rank(p, "source", official=F.col("lang") == "en", length="len", confidence="conf", multi_set=F.col("n_chars") % 2 == 0, target="target", position="doc_id").select("source", "doc_id", "len")


@query("WITH s AS (SELECT conv_id, count(DISTINCT role) AS sets, CAST(count(*) * 600 AS BIGINT) AS secs, CAST(conv_id % 4 AS BIGINT) AS ev, CASE WHEN conv_id % 5 = 0 THEN 2 END AS ex, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END AS br FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN ex IS NOT NULL AND ex <> sets THEN 'expected ' || ex || ' sets, found ' || sets WHEN br > 0 THEN NULL WHEN ev > 1 THEN 'evidence has several sets, tracks have no break' WHEN secs / 60 >= 60 THEN CAST(round_even(secs / 60, 0) AS BIGINT) || ' minutes without a set break' END AS flag FROM s")
def structure_guard(spark, d):
    s = t(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("sets"), (F.count(F.lit(1)) * 600).alias("secs"))
    s = s.withColumns({"ev": F.col("conv_id") % 4, "ex": F.when(F.col("conv_id") % 5 == 0, F.lit(2)), "br": F.when(F.col("conv_id") % 2 == 0, 0).otherwise(1)})
    return s.select("conv_id", structure.structure_guard(s, sets="sets", breaks="br", seconds="secs", expected="ex", evidence_sets="ev", most_minutes=60).alias("flag"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '--' || strftime(o_orderdate, '%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def normalize_dates(spark, d):
    o = t(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format("o_orderdate", "M/d/yy")).when(k == 1, F.date_format("o_orderdate", "EEEE, MMMM d, yyyy")).when(k == 2, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d"))
    return o.select("o_orderkey", X.normalize_date(written).alias("date"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'P' THEN 'held' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_totalprice > 200000 THEN 'packaged' WHEN o_orderpriority LIKE '2%' THEN 'briefed' WHEN o_orderpriority LIKE '3%' THEN 'vetted' ELSE 'selected' END AS state FROM orders")
def derive_state(spark, d):
    p = F.col("o_orderpriority")
    reached = {"held": p.startswith("1") & (F.col("o_orderstatus") == "P"), "delivered": F.col("o_orderstatus") == "F", "packaged": F.col("o_totalprice") > 200_000, "briefed": p.startswith("2"), "vetted": p.startswith("3"), "selected": F.lit(True)}
    return t(spark, d, "orders").select("o_orderkey", catalog.derive_state(reached).alias("state"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS k FROM events) SELECT user_id, event_type, ts, event_id FROM r WHERE k = 1")
def latest_disposition(spark, d):
    return catalog.latest_disposition(t(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) AS total FROM events GROUP BY 1")
def state_rollup(spark, d):
    return catalog.state_rollup(t(spark, d, "events"), "user_id", "event_type", ["purchase", "click", "view"])


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_id, user_id, event_type FROM r WHERE event_type <> 'purchase' OR k <= 5")
def recent_keep_5(spark, d):
    return catalog.recent_or_open(t(spark, d, "events"), ["user_id"], "event_type", [F.col("ts").desc(), F.col("event_id").desc()], 5, "purchase").select("event_id", "user_id", "event_type")


@query("WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events), n AS (SELECT user_id, event_type, day, min(event_id) AS event_id FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2, 3) SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE event_id % 2 = 0 AND e.user_id IS NOT DISTINCT FROM n.user_id AND e.event_type IS NOT DISTINCT FROM n.event_type AND e.day = n.day)")
def append_once(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return catalog.append_once(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type", "day"], "event_id").select("user_id", "event_type", "day", "event_id")


@query("SELECT doc_id, sha256(concat_ws('|', text, lang, source)) AS key FROM documents")
def content_key(spark, d):
    return t(spark, d, "documents").select("doc_id", X.content_key("text", "lang", "source").alias("key"))


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", X.normalize_title("text").alias("norm"))


@query("SELECT doc_id, trim(regexp_replace(replace(replace(replace(text, '>', ' into '), '&', ' and '), '%', ' percent '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS spoken FROM documents")
def speech_normalize(spark, d):
    return t(spark, d, "documents").select("doc_id", X.speech("text").alias("spoken"))


@query("SELECT l_orderkey, l_returnflag, sum(l_quantity) AS seconds, count(*) AS tracks FROM lineitem GROUP BY GROUPING SETS ((l_orderkey, l_returnflag), (l_orderkey))")
def set_durations(spark, d):
    return manifest.set_durations(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity")


def tracks(spark, d):
    return t(spark, d, "conversations").withColumn("title", F.concat(F.lit("r"), F.col("turn").cast("string")))


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations), e AS (SELECT conv_id, turn AS i, 0 AS o, 'intro' AS kind, 'intro-' || role AS entry FROM r WHERE k = 1 UNION ALL SELECT conv_id, turn, 1, 'track', 'r' || turn FROM r UNION ALL SELECT conv_id, max(turn), 2, 'outro', 'outro' FROM r GROUP BY 1) SELECT conv_id, kind, entry, row_number() OVER (PARTITION BY conv_id ORDER BY i, o) AS seq FROM e")
def interleave_playlist(spark, d):
    return manifest.interleave(tracks(spark, d), "conv_id", "turn", "role", "title").select("conv_id", "kind", "entry", "seq")


@query(f"WITH {LINES} SELECT l_orderkey, k, CAST(sum(CAST(round_even(l_quantity * 1000, 0) AS BIGINT)) OVER w AS BIGINT) - CAST(round_even(l_quantity * 1000, 0) AS BIGINT) AS start_ms, CAST(sum(CAST(round_even(l_quantity * 1000, 0) AS BIGINT)) OVER w AS BIGINT) AS end_ms FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING)")
def chapter_offsets(spark, d):
    return manifest.chapter_offsets(lines(spark, d), "l_orderkey", "k", "l_quantity").select("l_orderkey", "k", "start_ms", "end_ms")


@query("WITH a AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01') AS n_old, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-06-01') AS n_new FROM orders GROUP BY 1) SELECT *, n_new - n_old AS delta FROM a WHERE n_old <> n_new")
def refresh_diff(spark, d):
    o = t(spark, d, "orders")
    cut = F.to_timestamp(F.lit("1995-06-01"))
    return catalog.refresh_diff(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_custkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def event_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"WITH {ITEMS} SELECT (CAST(year AS INT) // 10 * 10) || 's' AS decade, count(*) AS items, avg(CASE WHEN rating IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS rated, median(downloads)::DOUBLE AS median_amount FROM items GROUP BY 1")
def census_buckets(spark, d):
    return census.decades(items(spark, d), "year", "downloads", "rating")


@query(f"WITH {ITEMS} SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM items GROUP BY artist, month) GROUP BY 1")
def census_group_sizes(spark, d):
    return census.group_sizes(items(spark, d), ["artist", "month"])


@query(f"WITH {ITEMS} SELECT CASE WHEN rating IS NULL THEN 'unrated' ELSE printf('%.1f', floor(rating / 0.5) * 0.5) END AS bucket, count(*) AS items FROM items GROUP BY 1")
def census_ratings(spark, d):
    return census.rating_buckets(items(spark, d), "rating")


@query("SELECT l_orderkey, max(s) AS largest, count(*) AS formats FROM (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def census_formats(spark, d):
    return census.largest_format(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity")


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS low, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS high FROM lineitem GROUP BY 1")
def census_interval(spark, d):
    out = census.mean_interval(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


TODAY = "2002-01-01"
RATINGS, REVIEWS = [2.0, 2.5, 3.0], [1, 2, 4, 6]
RATED = """CASE WHEN rating IS NULL THEN 'unrated' WHEN rating < 2 THEN '< 2' WHEN rating < 2.5 THEN '2 - 2.5' WHEN rating < 3 THEN '2.5 - 3' ELSE '3+' END"""
REVIEWED = """CASE WHEN reviews < 1 THEN '< 1' WHEN reviews < 2 THEN '1 - 2' WHEN reviews < 4 THEN '2 - 4' WHEN reviews < 6 THEN '4 - 6' ELSE '6+' END"""


def strata(spark, d):
    """Items by rating and reviews, with what a year brings since they came."""
    rate = census.yearly(F.col("downloads").cast("double"), "date", TODAY)
    return items(spark, d).select(census.stratum("rating", RATINGS, "unrated").alias("rated"), census.stratum("reviews", REVIEWS, "none").alias("reviewed"), rate.alias("rate"), F.col("year").cast("double").alias("year"))


@query(f"""WITH {ITEMS}
SELECT {RATED} AS rated, {REVIEWED} AS reviewed, count(*) AS n,
       round(median(downloads / greatest(1.0, date_diff('day', CAST(date AS DATE), DATE '{TODAY}') / 365.25)), 6) AS quantile
FROM items GROUP BY 1, 2""")
def census_rates(spark, d):
    """Median downloads a year by rating and number of reviews."""
    return census.quantiles(strata(spark, d), ["rated", "reviewed"], "rate").withColumn("quantile", F.round("quantile", 6))


@query(f"WITH {ITEMS} SELECT {REVIEWED} AS reviewed, count(*) AS n, quantile_cont(CAST(year AS DOUBLE), 0.9) AS quantile FROM items GROUP BY 1")
def census_years(spark, d):
    """The year that nine tenths of the items are older than, by number of reviews."""
    return census.quantiles(strata(spark, d), ["reviewed"], "year", 0.9)
