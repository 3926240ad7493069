"""Model tasks bound to the test tables, answered by readers of their prompts that also make the mistakes models make."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stagewise.operators import models
from stagewise.plans.registry import query, t
from stagewise.shipping import checkpointed

TEMPLATE = "Answer for each of these:\n{{items}}"


def told(prompt: str) -> list[dict]:
    """The items of a prompt; what stands behind their JSON is a note."""
    return json.JSONDecoder().raw_decode(prompt, prompt.index("["))[0]


def critic(prompt: str) -> str:
    """Scores by length. In batches it forgets some keys, answers some with a word and invents one; some it never answers."""
    items = told(prompt)
    rows = [{"conv_id": "ghost", "quality_score": 9}]
    for item in items:
        k, said = int(item["conv_id"]), item["reviews"] or ""
        score = len(said) % 101 / 10
        if k % 13 == 0 or (len(items) > 1 and k % 7 == 0):
            continue
        rows.append({"conv_id": item["conv_id"], "quality_score": "high" if len(items) > 1 and k % 11 == 0 else score, "recording_complaints": ["hiss", "cut"][: k % 3], "note": "?"})
    return "Here:\n```json\n" + json.dumps({"assessments": rows}) + "\n```"


@query("""WITH c AS (SELECT conv_id, length(coalesce(string_agg(text, chr(10) ORDER BY turn), '')) % 101 / 10 AS score FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 13 > 0 THEN score END AS quality_score, CASE WHEN conv_id % 13 > 0 THEN ['', 'hiss', 'hiss,cut'][CAST(conv_id % 3 + 1 AS INT)] END AS complaints,
  CASE WHEN conv_id % 13 > 0 THEN 'tape' || conv_id END AS reviewed_identifier, CASE WHEN conv_id % 13 = 0 THEN 'ValueError: ' || conv_id || ' has no row' END AS error FROM c""")
def scored_reviews(spark, d):
    """Every conversation's score from batches of five, or why it has none."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text")))), lambda x: x["text"])
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("reviews")).withColumn("tape", F.concat(F.lit("tape"), F.col("conv_id").cast("string")))
    good, failed = models.score_reviews(c, "conv_id", ["reviews"], TEMPLATE, critic, reviewed="tape", tries=2)
    good = good.select("conv_id", "quality_score", F.array_join("recording_complaints", ",").alias("complaints"), "reviewed_identifier")
    return good.unionByName(failed, allowMissingColumns=True)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 5 = l_linenumber % 5 THEN l_orderkey % 4 ELSE 0 END AS complaints FROM o""")
def reviewed_complaints(spark, d):
    """Complaints of an order's assessment, counted for the recording that was reviewed alone."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") % 5).cast("string").alias("item"))
    said = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5).cast("string").alias("reviewed_identifier"), F.slice(F.array(*map(F.lit, ["hiss", "cut", "hum"])), 1, (F.col("o_orderkey") % 4).cast("int")).alias("recording_complaints"))
    return models.complaints(rows, said, "l_orderkey", "item").select("l_orderkey", "l_linenumber", "l_quantity", F.col("complaints").cast("long").alias("complaints"))


def reader(prompt: str) -> str:
    """What a text says line by line of songs, dates and sets; texts without such lines get no answer."""
    rows = []
    for item in told(prompt):
        said = [line.partition(": ")[::2] for line in (item["said"] or "").split("\n")]
        pick = lambda kind, said=said: [x for k, x in said if k == kind]
        if pick("song"):
            rows.append({"show_id": item["show_id"], "asserted_songs": pick("song"), "asserted_dates": pick("date"), "asserted_set_count": int(pick("sets")[0])})
    return json.dumps({"shows": rows})


#: Research on an order names its parts, and for every third line another part; its date is the order's, or another one's, in words.
RESEARCH = """l AS (SELECT l_orderkey AS show_id, l_linenumber AS n, p_name, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT l.show_id, l.n, CASE WHEN l.n % 3 = 0 THEN p.p_name ELSE l.p_name END AS song FROM l JOIN part p ON p.p_partkey = (l.l_partkey + l.n) % (SELECT count(*) FROM part)),
k AS (SELECT DISTINCT show_id, p_name FROM l),
j AS (SELECT a.show_id, a.song, k.p_name IS NULL AS unknown FROM a LEFT JOIN k ON k.show_id = a.show_id AND k.p_name = a.song)"""


@query(f"""WITH {RESEARCH}, s AS (SELECT show_id, count(*) AS asserted, count(*) FILTER (WHERE unknown) AS unknown, coalesce(string_agg(song, '; ' ORDER BY song) FILTER (WHERE unknown), '') AS names FROM j GROUP BY 1)
SELECT o_orderkey AS show_id, asserted, unknown, names, unknown >= 2 AND unknown * 3 > asserted AS flagged,
  CASE WHEN o_orderkey % 4 = 0 AND strftime(o_orderdate, '%m-%d') <> '01-01' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') ELSE '' END AS wrong_dates,
  CASE WHEN o_orderkey % 4 = 1 AND strftime(o_orderdate, '%m-%d') <> '01-01' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 0 AND strftime(o_orderdate, '%m-%d') = '01-01' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS adopted,
  o_orderkey % 3 + 1 AS set_count, NULL AS error
FROM orders JOIN s ON show_id = o_orderkey
UNION ALL SELECT o_orderkey, 0, 0, '', false, '', NULL, 0, 'ValueError: ' || o_orderkey || ' has no row' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def vetted_research(spark, d):
    """What research on orders claims against what is known of them: songs, and dates, of which placeholders are replaced."""
    part = t(spark, d, "part").select("p_partkey", "p_name")
    n = part.count()
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("show_id"), F.col("l_linenumber").alias("n"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    other = part.select(F.col("p_partkey").alias("__p"), F.col("p_name").alias("other"))
    said = rows.withColumn("__at", (F.col("l_partkey") + F.col("n")) % n).join(other, F.col("__at") == F.col("__p")).withColumn("song", F.when(F.col("n") % 3 == 0, F.col("other")).otherwise(F.col("p_name")))
    songs = said.groupBy(F.col("show_id").alias("__s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "song"))), lambda x: F.concat(F.lit("song: "), x["song"])), "\n").alias("songs"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    written = F.date_format(F.when(k % 4 == 0, F.date_add(day, 1)).otherwise(F.to_date(day)), "EEEE, MMMM d, yyyy")
    orders = t(spark, d, "orders").join(songs, k == F.col("__s"), "left")
    text = F.concat(F.lit("On this order.\n"), F.coalesce("songs", F.lit("")), F.lit("\ndate: "), written, F.lit("\nsets: "), (k % 3 + 1).cast("string"))
    research = orders.select(k.alias("show_id"), text.alias("said"))
    dates = orders.select(k.alias("show_id"), F.when(k % 4 == 1, F.date_format(day, "yyyy-01-01")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date"))
    good, failed = models.vet_research(research, rows, dates, "show_id", "said", "p_name", "date", TEMPLATE, reader, tries=2)
    good = good.withColumns({"names": F.array_join("names", "; "), "wrong_dates": F.array_join("wrong_dates", "; "), "asserted": F.col("asserted").cast("long"), "set_count": F.col("set_count").cast("long")})
    return good.unionByName(failed, allowMissingColumns=True).na.fill({"asserted": 0, "unknown": 0, "names": "", "flagged": False, "wrong_dates": "", "set_count": 0})


def splitter(prompt: str) -> str:
    """Sets by place: the first half is set 1, the rest set 2. Some shows' tracks are numbered wrongly, or stand in a set that can't be."""
    rows = []
    for item in told(prompt):
        show_id, tracks, listed = int(item["show_id"]), item["tracks"], {x["title"] for x in item["setlist"] or []}
        half = (len(tracks) + 1) // 2
        out = [{"index": x["index"], "set": "1" if k < half else "2", "segue": k % 2 == 1, "matched_title": x["title"] if x["title"] in listed else ""} for k, x in enumerate(tracks)]
        if show_id % 5 == 0:
            out[-1]["set"] = "9"
        if show_id % 7 == 0:
            out[-1]["index"] = 1 + len(out)
        rows.append({"show_id": item["show_id"], "tracks": out})
    return json.dumps({"shows": rows})


@query("""WITH x AS (SELECT l_orderkey AS show_id, p_name, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT *, bool_or(l_quantity > 20) OVER (PARTITION BY show_id, p_name) AS matched FROM x)
SELECT show_id, k, CASE WHEN k <= (n + 1) // 2 THEN '1' ELSE '2' END AS set_label, k % 2 = 0 AS segue, matched, round(avg(CAST(matched AS INT)) OVER (PARTITION BY show_id), 9) AS coverage FROM m WHERE show_id % 5 > 0 AND show_id % 7 > 0""")
def aligned_by_model(spark, d):
    """Sets of an order's lines as a model gives them; answers that don't name each line once with a known set are left alone."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("show_id"), *order).join(t(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = checkpointed(rows.groupBy("show_id").agg(F.array_sort(F.collect_list(F.struct(*order, "p_name"))).alias("all")).select("show_id", F.posexplode("all").alias("at", "x")).select("show_id", (F.col("at") + 1).alias("k"), "x.p_name", "x.l_quantity"))
    items = rows.where("l_quantity > 20").withColumn("set", F.lit("1"))
    good, _ = models.align_structures(rows, items, "show_id", "k", "p_name", "k", "p_name", "set", TEMPLATE, splitter)
    return good.select("show_id", F.col("k").cast("long").alias("k"), "set_label", "segue", "matched", F.round("coverage", 9).alias("coverage"))


def lister(prompt: str) -> str:
    """Each line of a text that isn't blank is a song; of some texts the confidence is none that is known."""
    rows = []
    for item in told(prompt):
        lines = [x for x in (item["text"] or "").split("\n") if x.strip(" ")]
        trust = ["high", "sure", None][int(item["doc_id"]) % 3]
        rows.append({"doc_id": item["doc_id"], "items": [{"title": x, "set": "1" if k < 3 else "2", "segue": None} for k, x in enumerate(lines)], "confidence": trust})
    return json.dumps({"setlists": rows})


@query("""WITH x AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS songs FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, CAST(len(songs) AS BIGINT) AS n_songs, CAST(greatest(len(songs) - 3, 0) AS BIGINT) AS n_second, md5(array_to_string(songs, chr(10))) AS titles_md5 FROM x""")
def extracted_setlists(spark, d):
    """Setlists that a model reads out of the whole texts of documents."""
    good, _ = models.extract_setlists(t(spark, d, "documents"), "doc_id", "text", TEMPLATE, lister)
    second = F.size(F.filter("items", lambda x: (x["set"] == "2") & ~x["segue"]))
    return good.select("doc_id", "confidence", F.size("items").cast("long").alias("n_songs"), second.cast("long").alias("n_second"), F.md5(F.array_join(F.transform("items", lambda x: x["title"]), "\n")).alias("titles_md5"))
