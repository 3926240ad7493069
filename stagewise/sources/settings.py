"""Profiles, presenters and configuration: small TOML files, read all at once. A bad file is a row with its error."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CRITERIA = "struct<query:string,collection:string,artist:string,date_from:string,date_to:string,setlist_constraints:array<struct<sequence:array<string>>>,soft_preferences:string,min_avg_rating:double,min_reviews:int,count:int,artist_cap:double,year_cap:double,min_quality_score:double,artists:array<string>,profile:string>"
PROFILE = f"name string, criteria {CRITERIA}, count int, human_gate boolean"
PRESENTER = "name string, sex string, voice string, voice_clone string, character string, bed string"
#: What a profile's criteria are where the file doesn't say.
CRITERIA_DEFAULTS = {"min_avg_rating": 3.5, "min_reviews": 3, "count": 1, "artist_cap": 1 / 3, "year_cap": 1.0, "min_quality_score": 6.0}


def toml_texts(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of the *.toml files right under a folder; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "name string, text string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.toml").load(folder)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.toml$", 1).alias("name"), F.decode("content", "utf-8").alias("text"))
    # Spark's scans leave out files of no bytes
    empty = [(s.getPath().getName().removesuffix(".toml"), "") for s in fs.listStatus(path) if s.isFile() and not s.getLen() and s.getPath().getName().endswith(".toml")]
    return rows.unionByName(spark.createDataFrame(empty, "name string, text string"))


def parsed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, json, error of TOML texts: a text that is no TOML has an error and no json."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str | None] = []
            errors: list[str | None] = []
            for one in batch.column(1).to_pylist():
                try:
                    found.append(json.dumps(tomllib.loads(one or ""), default=str))  # dates and times as text
                    errors.append(None)
                except (tomllib.TOMLDecodeError, RecursionError, ValueError) as e:
                    found.append(None)
                    errors.append(f"no TOML: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(errors, pa.string())], names=[key, "json", "error"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, json string, error string")


def records(texts: DataFrame, key: str, text: str, schema: str, rules: Mapping[str, Column], nested: str | None = None) -> DataFrame:
    """key, the schema's columns, error: the first of these that holds: no TOML; a value that isn't of its column's type; a rule that is broken (name: what must hold; null is broken).

    Values aren't converted: a number in quotes is no number. nested: the struct whose fields are tested by themselves, too.
    """
    kinds = StructType.fromDDL(schema)
    rows = parsed(texts, key, text).withColumn("__r", F.from_json("json", schema))
    wrong = lambda raw, record, fields: [F.when(F.try_element_at(raw, F.lit(f.name)).isNotNull() & record[f.name].isNull(), F.lit(f"{f.name}: no {f.dataType.simpleString() if f.name != nested else 'table'}")) for f in fields]
    tests = wrong(F.from_json("json", "map<string,string>"), F.col("__r"), kinds)
    if nested:
        tests += wrong(F.from_json(F.get_json_object("json", f"$.{nested}"), "map<string,string>"), F.col("__r")[nested], kinds[nested].dataType)
    rows = rows.withColumn("error", F.coalesce("error", *tests))
    rows = rows.select(key, "__r.*", "error")
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("error", F.coalesce("error", *broken))


def profiles(texts: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """file, name, criteria, count, human_gate, error of profiles, with defaults for what they leave out."""
    c = F.col("criteria")
    share = lambda name: c[name].isNull() | ((c[name] > 0) & (c[name] <= 1))
    rules = {"name is missing": F.col("name").isNotNull(), "criteria.query is missing": c["query"].isNotNull(), "artist_cap isn't above 0 and up to 1": share("artist_cap"), "year_cap isn't above 0 and up to 1": share("year_cap"), "min_quality_score isn't 0 to 10": c["min_quality_score"].isNull() | c["min_quality_score"].between(0, 10)}
    rows = records(texts.select(F.col(key).alias("file"), F.col(text).alias("text")), "file", "text", PROFILE, rules, "criteria")
    filled = c
    for name, value in CRITERIA_DEFAULTS.items():
        filled = filled.withField(name, F.coalesce(c[name], F.lit(value)))
    return rows.withColumns({"criteria": F.when(c.isNotNull(), filled), "count": F.coalesce("count", F.lit(1)), "human_gate": F.coalesce("human_gate", F.lit(False))})


def presenters(texts: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """id, name, sex, voice, voice_clone, character, bed, voice_id, error of presenters: each has one of voice and voice_clone."""
    given = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    rules = {f"{n} is missing": F.col(n).isNotNull() for n in ("name", "sex", "character")} | {"exactly one of voice and voice_clone is needed": given("voice") != given("voice_clone")}
    rows = records(texts.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", "text", PRESENTER, rules)
    return rows.withColumn("voice_id", F.when(given("voice"), F.col("voice")).otherwise(F.col("voice_clone")))


def model_settings(texts: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """key, tasks (by name, settings as text), tiers (by provider, models by tier), error of the llm table of configurations: its table of tiers is lifted out of the tasks."""
    rows = parsed(texts, key, text)
    llm = F.from_json(F.get_json_object("json", "$.llm"), "map<string,string>")
    tasks = F.transform_values(F.map_filter(llm, lambda k, _: k != "tiers"), lambda _, v: F.from_json(v, "map<string,string>"))
    return rows.select(key, tasks.alias("tasks"), F.from_json(F.try_element_at(llm, F.lit("tiers")), "map<string,map<string,string>>").alias("tiers"), "error")


def setting_for(tasks: Column, task: str) -> Column:
    """A task's settings, else the default's."""
    return F.coalesce(F.try_element_at(tasks, F.lit(task)), F.try_element_at(tasks, F.lit("default")))
