"""Files of an item: junk filter, format preference, play order, titles, siblings, and the choice of a recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.text import LINEAGE_SCORES, is_digits, is_real_title, try_int

#: The floor on durations is a share of the median, or absolute where the sample is small.
SHARE_OF_MEDIAN, LEAST_SAMPLE, ABSOLUTE_FLOOR = 0.25, 5, 90.0
#: Files that one task judges at most, but for an item with more of them.
TASK_ROWS = 250_000


def junk_filter(files: DataFrame, item: str, *, name: str, stem: str, source: str, original: str, seconds: str, position: str) -> DataFrame:
    """files with reasons (empty: kept), in order: provenance, naming convention, duration.

    A derivative's original must be a file of the item; the stem must be the item's most frequent (first on a tie);
    the duration must reach a floor taken from the median of files without another reason.
    """
    # rows of a task are bounded, and they carry flags, not lists of all their item's names
    files = files.repartition(max(1, -(-files.count() // TASK_ROWS)), item)
    whole = Window.partitionBy(item)
    same_stem = Window.partitionBy(item, stem)
    same_original = Window.partitionBy(item, F.when(F.col(source) == "original", F.col(name)).otherwise(F.col(original)))
    rows = files.withColumn("__has", F.max(F.coalesce(F.col(source) == "original", F.lit(False))).over(same_original))
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(same_stem), "__p": F.min(position).over(same_stem)})
    rows = rows.withColumn("__dominant", F.min(F.struct(-F.col("__n"), F.col("__p"), F.col(stem).alias("stem"))).over(whole)["stem"])
    provenance = F.when(F.col(source) == "derivative", F.when(~F.col("__has") | F.col(original).isNull(), F.lit("derivative of unknown original"))).when(F.coalesce(F.col(source), F.lit("")) != "original", F.lit("unknown provenance"))
    convention = F.when(~F.col(stem).eqNullSafe(F.col("__dominant")), F.lit("filename convention mismatch"))
    rows = rows.withColumn("__other", F.array_compact(F.array(provenance, convention)))
    clean = F.when((F.size("__other") == 0) & F.col(seconds).isNotNull(), F.col(seconds))
    rows = rows.withColumns({"__clean": F.count(clean).over(whole), "__median": F.median(clean).over(whole)})
    floor = F.when(F.col("__clean") >= LEAST_SAMPLE, F.col("__median") * SHARE_OF_MEDIAN).otherwise(F.lit(ABSOLUTE_FLOOR))
    duration = F.when(F.col(seconds).isNull(), F.lit("missing duration")).when(F.col(seconds) < floor, F.lit("implausibly short"))
    rows = rows.withColumn("reasons", F.array_compact(F.concat("__other", F.array(duration))))
    return rows.drop("__n", "__p", "__has", "__dominant", "__other", "__clean", "__median")


def duration_floor(files: DataFrame, item: str, seconds: str) -> DataFrame:
    """item with n files and the floor that their durations set."""
    agg = files.groupBy(item).agg(F.count(seconds).alias("n"), F.median(seconds).alias("__m"))
    return agg.select(item, "n", F.when(F.col("n") >= LEAST_SAMPLE, F.col("__m") * SHARE_OF_MEDIAN).otherwise(F.lit(ABSOLUTE_FLOOR)).alias("floor_sec"))


def format_preference(files: DataFrame, item: str, kind: str, kept: Column, preference: Sequence[str]) -> DataFrame:
    """item with the first preferred format that has a kept file, else the first that has any, and its numbers of files."""
    # two counts for each format: one hashed row an item, and nothing to sort
    counts = [x for k, p in enumerate(preference) for x in (F.count_if((F.col(kind) == p) & kept).alias(f"__kept{k}"), F.count_if(F.col(kind) == p).alias(f"__files{k}"))]
    by = files.where(F.col(kind).isin(list(preference))).groupBy(item).agg(*counts)
    found = F.array(*[F.when(F.col(f"__files{k}") > 0, F.struct((F.col(f"__kept{k}") == 0).alias("none"), F.lit(k).alias("o"), F.lit(p).alias("kind"), F.col(f"__kept{k}").alias("n_kept"), F.col(f"__files{k}").alias("n_files"))) for k, p in enumerate(preference)])
    best = by.select(item, F.array_min(found).alias("b"))
    return best.select(item, F.col("b.kind").alias(kind), F.col("b.n_kept").alias("n_kept"), F.col("b.n_files").alias("n_files"))


def play_order(files: DataFrame, item: str, track: str, name: str) -> DataFrame:
    """files with position, by track number if the item's are complete and unique, else by name, and reordered: whether that differs from the order of names."""
    whole = Window.partitionBy(item)
    rows = files.withColumns({"__all": F.count(F.lit(1)).over(whole), "__with": F.count(track).over(whole), "__kinds": F.size(F.collect_set(track).over(whole))})
    tagged = (F.col("__all") == F.col("__with")) & (F.col("__kinds") == F.col("__all"))
    rows = rows.withColumn("__tagged", tagged)
    rows = rows.withColumn("__name", F.row_number().over(whole.orderBy(name)))
    rows = rows.withColumn("position", F.row_number().over(whole.orderBy(F.when(F.col("__tagged"), F.col(track)), F.col(name))).cast("long"))
    rows = rows.withColumn("reordered", F.max(F.col("__name") != F.col("position")).over(whole))
    return rows.drop("__all", "__with", "__kinds", "__tagged", "__name")


def track_numbers(files: DataFrame, item: str, *, name: str, source: str, original: str, track: str) -> DataFrame:
    """files with number: the leading integer of an original's track tag; of any other file, that of the original it is made from."""
    first = try_int(F.regexp_extract(F.col(track).cast("string"), r"^\s*(\d+)", 1))
    of = files.where(F.col(source) == "original").groupBy(F.col(item).alias("__i"), F.col(name).alias("__o")).agg(F.min_by(first, F.coalesce(track, F.lit("")).cast("string")).alias("__number"))
    rows = files.join(of, (F.col(item) == F.col("__i")) & (F.col(original) == F.col("__o")), "left")
    return rows.withColumn("number", F.when(F.col(source) == "original", first).otherwise(F.col("__number"))).drop("__i", "__o", "__number")


def title_fraction(titles: DataFrame, item: str, title: str) -> DataFrame:
    """Share of titles that are real (three letters at least)."""
    return titles.groupBy(item).agg(F.count_if(is_real_title(title)).alias("n_real"), F.count(F.lit(1)).alias("n"), F.avg(is_real_title(title).cast("double")).alias("fraction"))


def sibling_bijection(a: DataFrame, b: DataFrame, item: str, stem: str) -> DataFrame:
    """item with matched: whether the stems on both sides are the same set, without repeats; only items on either side."""
    left = a.groupBy(item, stem).agg(F.count(F.lit(1)).alias("__a"))
    right = b.groupBy(item, stem).agg(F.count(F.lit(1)).alias("__b"))
    both = left.join(right, [item, stem], "full_outer").na.fill(0, ["__a", "__b"])
    return both.groupBy(item).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"), F.bool_and((F.col("__a") == 1) & (F.col("__b") == 1)).alias("matched"))


def resolve_titles(rows: DataFrame, candidates: Sequence[tuple[str, Column]], fallback: Column) -> DataFrame:
    """rows with title and title_source: the first candidate that is a real title, else the fallback, unresolved."""
    title, source = fallback, F.lit("unresolved")
    for name, c in reversed(list(candidates)):
        title, source = F.when(is_real_title(c), c).otherwise(title), F.when(is_real_title(c), F.lit(name)).otherwise(source)
    return rows.withColumns({"title": title, "title_source": source})


def strip_numbering(rows: DataFrame, item: str, title: str) -> DataFrame:
    """A leading number (three digits at most, maybe a sign, a blank) goes where at least three titles of the item, and 80 percent, have one."""
    parts = F.split(F.col(title), r"\s+", 2)
    head, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    number = F.when(F.right(head, F.lit(1)).isin(".", ")", "-", ":"), F.left(head, F.length(head) - 1)).otherwise(head)
    numbered = F.coalesce(is_digits(number, 1, 3) & (rest != ""), F.lit(False))
    whole = Window.partitionBy(item)
    gate = (F.count_if(numbered).over(whole) >= 3) & (F.count_if(numbered).over(whole) >= 0.8 * F.count(F.lit(1)).over(whole))
    return rows.withColumn(title, F.when(gate & numbered, rest).otherwise(F.col(title)))


def pattern_bonus(rows: DataFrame, group: str, name: str, newness: Sequence[Column], patterns: dict[str, float]) -> DataFrame:
    """rows with bonus: of a pattern's matches within a group, the newest gets all, the rest half; the best over patterns."""
    found = F.lit(0.0)
    for k, (pattern, bonus) in enumerate(patterns.items()):
        hit = F.contains(F.lower(F.col(name)), F.lit(pattern.lower()))
        place = F.row_number().over(Window.partitionBy(group, hit).orderBy(*newness))
        rows = rows.withColumn(f"__b{k}", F.when(hit & (place == 1), bonus).when(hit, bonus / 2).otherwise(0.0))
        found = F.greatest(found, F.col(f"__b{k}"))
    return rows.withColumn("bonus", found).drop(*[f"__b{k}" for k in range(len(patterns))])


def era_override(rows: DataFrame, collection: str, date: str, eras: Sequence[tuple]) -> Column:
    """Name of the first era (name, collection, from, to) that holds the row, as a CASE: eras are configuration."""
    out = F.lit(None).cast("string")
    for name, c, start, end in reversed(list(eras)):
        out = F.when((F.col(collection) == c) & F.col(date).between(start, end), F.lit(name)).otherwise(out)
    return out


def recording_score(*, lineage: Column, rating: Column, reviews: Column, wanted_format: Column, completeness: Column, complaints: Column, bonus: Column | None = None, downloads_share: Column | None = None, title_share: Column | None = None, base: dict[str, float] | None = None) -> Column:
    """Unrounded score of a recording. Completeness scales all but complaints; a kind that the base table lacks counts 0."""
    zero = F.lit(0.0)
    table = F.create_map(*[F.lit(x) for kv in (base or LINEAGE_SCORES).items() for x in kv])
    kind = F.coalesce(F.try_element_at(table, lineage), zero)
    total = kind + F.coalesce(rating, zero) * F.log10(1 + F.greatest(reviews, F.lit(0))) + (bonus if bonus is not None else zero)
    total = total + 0.75 * (downloads_share if downloads_share is not None else zero) + 0.5 * (title_share if title_share is not None else zero) + F.when(wanted_format, 0.5).otherwise(0.0)
    return total * (0.5 + 0.5 * completeness) - 0.5 * F.least(complaints, F.lit(4))


def sibling_shares(rows: DataFrame, group: str, downloads: str, kept: str) -> DataFrame:
    """rows with downloads_share: log1p over the group's largest, and completeness: kept over the group's largest; 0 where that is 0."""
    whole = Window.partitionBy(group)
    most, top = F.max(F.log1p(downloads)).over(whole), F.max(kept).over(whole)
    return rows.withColumns({"downloads_share": F.when(most > 0, F.log1p(downloads) / most).otherwise(0.0), "completeness": F.when(top > 0, F.col(kept) / top).otherwise(0.0)})
