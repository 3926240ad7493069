"""Column functions over text, numbers and dates. All are built from native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagewise.functions.titles import ALIASES, BREAKS, DIFFERENT, ENCORE, FILLER_STEMS, FILLER_WORDS, PLACE_SHORT, PLACE_SKIPPED

#: What names the kind of a source, anywhere in the text, or as a word; tried in this order.
LINEAGE = [("matrix", ["matrix"], ["mtx"]), ("sbd", ["soundboard"], ["sbd"]), ("aud", [], ["aud", "audience"])]
#: Base score of each kind.
LINEAGE_SCORES = {"sbd": 3.0, "matrix": 2.5, "aud": 1.0, "unknown": 0.0}
#: Words before a date, less a "day" behind them, and what follows a day's number.
WEEKDAYS = ["mon", "tue", "tues", "wed", "wednes", "thu", "thur", "thus", "thurs", "fri", "sat", "satur", "sun"]
ORDINAL_ENDS = ["st", "nd", "rd", "th"]
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Extensions that tags carry, and signs at a tag's edges.
AUDIO = [".mp3", ".flac", ".ogg", ".shn"]
EDGES = " \t-–—_.|"
#: A run of other signs than a-z, 0-9 and blanks. Its first sign is sought by single characters, which Java looks up in a table;
#: ranges with a blank are nested calls, in which the threads of an executor hinder each other, so they only see the rest of a run.
SIGNS = f"[^{DIGITS}{LETTERS[:26]} ](?:[^a-z0-9 ]+)?"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_of(text: Column) -> Column:
    """Runs of letters, digits and underscores; empty ones at the edges where the text begins or ends otherwise."""
    return F.split(text, r"[^\p{L}\p{N}_]+")


def is_digits(text: Column, least: int, most: int) -> Column:
    return F.length(text).between(least, most) & (F.translate(text, DIGITS, "") == "")


def try_int(c: str | Column) -> Column:
    """The integer, or null; never fails."""
    return F.trim(col(c).cast("string")).try_cast("bigint")


def nullif_empty(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_of(c: str | Column) -> Column:
    """First element of a JSON list, else the scalar itself."""
    raw = F.trim(col(c))
    return F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)


def valid_year(c: str | Column) -> Column:
    """Year if the value starts with four digits and lies in 1900 to 2100."""
    year = F.regexp_extract(col(c).cast("string"), r"^(\d{4})", 1).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def length_seconds(c: str | Column) -> Column:
    """Seconds of 'SS', 'MM:SS' or 'HH:MM:SS'; null if any part is no number."""
    parts = F.transform(F.split(F.trim(col(c).cast("string")), ":"), lambda x: F.trim(x).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when((F.size(parts) <= 3) & (F.trim(col(c).cast("string")) != ""), total)


def slug(c: str | Column) -> Column:
    s = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.coalesce(nullif_empty(F.regexp_replace(s, "^-+|-+$", "")), F.lit("unknown"))


def looked_up(c: Column, table: dict[str, str] | None) -> Column:
    """The table's value, or the text itself."""
    if not table:
        return c
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(F.array(c), lambda x: F.coalesce(F.try_element_at(known, x), x))[0]  # c is evaluated once


def normalize_title(c: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, straight apostrophes deleted, other signs to spaces, squeezed; then an alias, if there is one."""
    s = F.replace(F.lower(col(c)), F.lit("'"), F.lit(""))
    return looked_up(F.trim(F.regexp_replace(F.regexp_replace(s, SIGNS, " "), " +", " ")), aliases)


def fuzzy_title(c: str | Column, aliases: dict[str, str] | None = ALIASES, shorthand: dict[str, str] | None = None) -> Column:
    """normalize_title() without a leading encore mark, with & read as and; then a short name of the family's, if given."""
    marked = F.lower(F.trim(F.substring_index(col(c), ":", 1))).isin(*ENCORE) & F.contains(col(c), F.lit(":"))
    said = F.when(marked, F.substr(col(c), F.instr(col(c), ":") + 1)).otherwise(col(c))
    s = F.replace(said, F.lit("&"), F.lit(" and "))
    return looked_up(normalize_title(s, aliases), shorthand)


def without_credit(c: Column) -> Column:
    """Without a parenthesis that closes the text."""
    x = F.trim(c)
    body = F.left(x, F.length(x) - 1)
    last = F.substring_index(body, ")", -1)  # behind all other closing ones
    opened = F.instr(last, "(")
    return F.when(F.endswith(x, F.lit(")")) & (opened > 0), F.rtrim(F.left(body, F.length(body) - F.length(last) + opened - 1))).otherwise(x)


def title_parts(c: str | Column, shorthand: dict[str, str] | None = None) -> Column:
    """Normal forms of the songs of a merged title, in order, each without a closing parenthesis; the whole title's if nothing is left."""
    names = F.transform(F.split(col(c), "->|>|→"), without_credit)
    found = F.filter(F.transform(F.filter(names, lambda x: x != ""), lambda x: fuzzy_title(x, shorthand=shorthand)), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(fuzzy_title(c, shorthand=shorthand)))


def within_words(short: Column, long: Column) -> Column:
    """Whether the words of one normal form are a run of the other's."""
    return (short != "") & F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))


def same_song(a: Column, b: Column) -> Column:
    """Whether two normal forms are one song: equal, equal but for blanks, or one a run of two words at least of the other."""
    different = a.isin(*DIFFERENT) & b.isin(*DIFFERENT)
    part = lambda x, y: F.contains(x, F.lit(" ")) & (x != y) & within_words(x, y)
    closed = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return (a == b) | (~different & (part(a, b) | part(b, a) | (closed(a) == closed(b))))


def song_names(c: Column) -> Column:
    """What known_names() looks up for a song that prose names, in normal form: the whole name, and of each link of a chain its name and the parts of a list."""
    # signs between pieces are blanks in normal form, so each piece is normalised once, and longer names are put together from them
    joined = lambda x: looked_up(F.array_join(F.filter(x, lambda y: y != ""), " "), ALIASES)
    pieces = lambda x, sign: F.filter(F.split(x, sign), lambda y: F.trim(y) != "")
    several = lambda x, sign, body: F.transform(F.array(pieces(x, sign)), lambda y: F.transform(F.when(F.size(y) > 1, y).otherwise(F.array(x)), body))[0]
    links = several(c, "->|>|→", lambda x: several(x, ",", lambda y: normalize_title(y)))
    told = lambda x: F.struct(joined(F.flatten(x)).alias("whole"), F.transform(x, lambda y: F.struct(joined(y).alias("name"), F.transform(y, lambda z: looked_up(z, ALIASES)).alias("parts"))).alias("links"))
    return F.when(c.isNotNull(), F.transform(F.array(links), told)[0])


def known_names(names: Column, known: Column) -> Column:
    """known_song() of song_names()."""
    has = lambda x: F.array_contains(known, x)
    loose = lambda x: F.exists(known, lambda k: within_words(x, k) | within_words(k, x))
    return has(names["whole"]) | F.forall(names["links"], lambda x: has(x["name"]) | F.forall(x["parts"], lambda y: has(y) | loose(y)))


def known_song(c: Column, known: Column) -> Column:
    """Whether a song that prose names is among known normal forms.

    A whole name must be one of them; else a chain of songs is known if every part is, and so is a list with commas;
    a single title may also be a run of a known one's words, or the other way round.
    """
    return F.transform(F.array(song_names(c)), lambda x: known_names(x, known))[0]


def is_filler(c: str | Column) -> Column:
    """Whether a title says tuning, talk, applause or the like anywhere: no song of a setlist."""
    said = F.lower(col(c))
    words = words_of(said)
    sentence = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    closed = F.regexp_replace(said, r"[\s-]+", "")
    found = [F.contains(said, F.lit(x)) for x in FILLER_STEMS] + [F.contains(closed, F.lit("tuneup")), F.arrays_overlap(words, F.array(*map(F.lit, FILLER_WORDS)))] + [F.contains(sentence, F.lit(f" {x} ")) for x in BREAKS]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def artist_key(c: str | Column) -> Column:
    """& read as and, lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(F.replace(col(c), F.lit("&"), F.lit(" and "))), r"[^\p{L}\p{N}]", "")


def ascii_key(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def clean_tag(c: str | Column) -> Column:
    """A tag's title without an item's identifier before it, an audio extension, and blanks or signs at the edges; "unknown" is empty."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    # an identifier: two to five letters, a date with a year of two or four figures, then disc and track, each a letter and a number
    behind = F.ltrim(s, F.lit(LETTERS))
    date = F.ltrim(behind, F.lit("_"))
    shape = F.translate(F.left(date, F.lit(10)), DIGITS + ".", "#" * 10 + "-")
    size = F.when(shape == "####-##-##", 10).when(F.startswith(shape, F.lit("##-##-##")), 8)
    rest = F.ltrim(F.substr(date, size + 1), F.lit(" \t"))
    place = lambda x, _: F.when(F.left(x, F.lit(1)).isin("t", "d") & is_digits(F.substring(x, 2, 1), 1, 1), F.ltrim(F.substring(x, 2, 1 << 20), F.lit(DIGITS))).otherwise(x)
    rest = F.aggregate(F.sequence(F.lit(0), F.length(rest)), rest, place)
    s = F.when((F.length(s) - F.length(behind)).between(2, 5) & size.isNotNull(), rest).otherwise(s)
    bare = F.rtrim(s)
    s = F.when(reduce(lambda a, b: a | b, [F.endswith(F.lower(bare), F.lit(x)) for x in AUDIO]), F.left(bare, F.length(bare) - F.length(F.element_at(F.split(bare, r"\."), -1)) - 1)).otherwise(s)
    s = F.trim(s, F.lit(EDGES))
    return F.when(F.lower(s) == "unknown", F.lit("")).otherwise(s)


def is_real_title(c: str | Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^A-Za-z]", "")) >= 3


def name_stem(c: str | Column) -> Column:
    """The part before the first digit: an item's naming convention."""
    return F.regexp_extract(col(c), "^[^0-9]*", 0)


def stem_no_extension(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"\.[^./]*$", "")


def newest_number(c: str | Column) -> Column:
    """Largest integer in the text, 0 without any."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("decimal(38,0)"))
    return F.coalesce(F.array_max(found), F.lit(0).cast("decimal(38,0)"))


def lineage_class(*columns: str | Column) -> Column:
    """First kind whose words occur in any of the columns: matrix, sbd, aud, else unknown."""
    text = F.lower(F.concat_ws(" ", *[col(c) for c in columns]))
    words = words_of(text)
    says = lambda parts, whole: reduce(lambda a, b: a | b, [*(F.contains(text, F.lit(x)) for x in parts), *(F.array_contains(words, x) for x in whole)])
    return reduce(lambda rest, kind: F.when(says(*kind[1:]), kind[0]).otherwise(rest), reversed(LINEAGE), F.lit("unknown"))


def event_kind(c: str | Column) -> Column:
    """What the suffix of a performance id says: event N, spans, unassigned, or nothing."""
    last = F.regexp_extract(col(c), r"/(e\d+|early|late|spans|unassigned)$", 1)
    return F.when(last.rlike(r"^e\d+$"), F.concat(F.lit("event "), F.substring(last, 2, 9))).when(last != "", last)


def parse_performance_id(c: str | Column) -> Column:
    """(collection, date, event) of `collection/date` or `collection/date/eN`; null for other texts."""
    pattern = r"^([^/\s]+)/(\d{4}-\d{2}-\d{2})(?:/e(\d+))?$"
    get = lambda k: F.regexp_extract(col(c), pattern, k)
    return F.when(col(c).rlike(pattern), F.struct(get(1).alias("collection"), get(2).alias("date"), get(3).try_cast("int").alias("event")))


def contains_sequence(text: Column, sequence: list[str] | Column) -> Column:
    """Whether the normalised words of `sequence` occur in normalised text in this order, on word boundaries, with anything between."""
    hay = F.concat(F.lit(" "), text, F.lit(" "))
    steps = F.array(*[F.lit(s) for s in sequence]) if isinstance(sequence, list) else sequence
    # the rest of the text behind each hit; null when a step is missed; the blank behind a hit opens the next
    rest = F.aggregate(steps, hay, lambda left, needle: F.when(F.instr(left, F.concat(F.lit(" "), needle, F.lit(" "))) > 0, F.substr(left, F.instr(left, F.concat(F.lit(" "), needle, F.lit(" "))) + F.length(needle) + 1)))
    return rest.isNotNull()


def speech(c: str | Column, lexicon: dict[str, str] | None = None) -> Column:
    """For reading aloud: > to into, & to and, % to percent, whole phrases of the lexicon (longest first), blanks squeezed."""
    s = col(c)
    for sign, word in ((">", " into "), ("&", " and "), ("%", " percent ")):
        s = F.replace(s, F.lit(sign), F.lit(word))
    for written in sorted(lexicon or {}, key=lambda k: (-len(k), k)):
        s = F.regexp_replace(s, rf"(?<!\w)\Q{written}\E(?!\w)", lexicon[written])
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def content_key(*columns: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", *[col(c).cast("string") for c in columns]), 256)


def format_count(c: str | Column) -> Column:
    """999 as it is, 1.5k, 2.0M; from 999,950 on in millions."""
    n = col(c)
    return F.when(n >= 999_950, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("string"))


def format_duration(c: str | Column) -> Column:
    s = F.floor(col(c)).cast("int")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60))


def packaged_filename(index: Column, title: Column, extension: Column) -> Column:
    safe = F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"\s+", " "))
    return F.format_string("%02d - %s%s", index, F.coalesce(nullif_empty(safe), F.lit("untitled")), extension)


def place_words(c: str | Column) -> Column:
    """Words of a place's name, without those that say nothing."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*sorted(PLACE_SKIPPED)))


def same_place(a: str | Column, b: str | Column) -> Column:
    """Whether two names may be one place: all words of one among the other's, or words and initials of one that spell the other."""
    spelled = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, sorted(x))) for kv in PLACE_SHORT.items() for x in kv])
    means = lambda w: F.coalesce(F.try_element_at(spelled, w), F.array(w))
    same = lambda v, w: (v == w) | F.arrays_overlap(means(v), means(w))
    x, y = place_words(a), place_words(b)
    among = lambda p, q: F.forall(p, lambda v: F.exists(q, lambda w: same(v, w)))

    def spells(short: Column, long: Column) -> Column:
        """How far into long the words of short have come, one by one; null where one doesn't fit."""
        initials = F.array_join(F.transform(long, lambda w: F.substring(w, 1, 1)), "")
        step = lambda at, v: F.when(same(v, F.get(long, at)), at + 1).when(v.rlike("^[a-z]{2,}$") & (F.substr(initials, at + 1, F.length(v)) == v), at + F.length(v))
        return F.coalesce(F.aggregate(short, F.lit(0), step) == F.size(long), F.lit(False))

    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both, among(x, y) | among(y, x) | spells(x, y) | spells(y, x)).otherwise((F.size(x) == 0) & (F.size(y) == 0))


def normalize_date(c: str | Column) -> Column:
    """YYYY-MM-DD of the ways to write a date in prose, --MM-DD without a year; null otherwise.

    1977-5-8, 5/8/77, May 8th, 1977, 8 May '77, and those without a year. Two-digit years from 30 on are in the last century. Weekdays
    before a date are skipped; months may be cut to three letters or more. No calendar check: values are compared as text.
    """
    said = F.split(F.trim(F.regexp_replace(F.lower(col(c)), r"[,.\s]+", " ")), " ")
    first = F.get(said, F.lit(0))
    first = F.when(F.endswith(first, F.lit("day")), F.left(first, F.length(first) - 3)).otherwise(first)
    months = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for n in range(3, len(m) + 1) for x in (m[:n], f"{k:02d}")])

    def two(x: Column) -> Column:
        return F.when(is_digits(x, 1, 2), F.lpad(x, 2, "0"))

    def day(x: Column) -> Column:
        return F.coalesce(two(x), F.when(F.right(x, F.lit(2)).isin(*ORDINAL_ENDS), two(F.left(x, F.length(x) - 2))))

    def year(x: Column) -> Column:
        figures = F.when(F.startswith(x, F.lit("'")), F.substring(x, 2, 9)).otherwise(x)
        n = F.when(is_digits(figures, 2, 4), figures.try_cast("int"))
        return F.lpad(F.when(n >= 100, n).when(n >= 30, n + 1900).otherwise(F.when(n >= 0, n + 2000)).cast("string"), 4, "0")

    def read(words: Column) -> Column:
        """What the words say by how many they are, each read as a month's name, a day or a year; null as soon as one is no such thing."""
        at = lambda parts, k: F.get(parts, F.lit(k))
        dashed, slashed = F.split(at(words, 0), "-"), F.split(at(words, 0), "/")
        iso = F.concat_ws("-", F.when(is_digits(at(dashed, 0), 4, 4), at(dashed, 0)), two(at(dashed, 1)), two(at(dashed, 2)))
        named = F.try_element_at(months, at(words, 0))
        month, of = F.coalesce(named, F.try_element_at(months, at(words, 1))), F.when(named.isNotNull(), at(words, 1)).otherwise(at(words, 0))
        join = lambda *x: F.when(reduce(lambda a, b: a & b, [y.isNotNull() for y in x]), F.concat_ws("-", *x))
        one = F.when(F.size(dashed) == 3, F.when(F.length(iso) == 10, iso)).when(F.size(slashed) == 3, join(year(at(slashed, 2)), two(at(slashed, 0)), two(at(slashed, 1)))).when(F.size(slashed) == 2, join(F.lit("-"), two(at(slashed, 0)), two(at(slashed, 1))))
        return F.when(F.size(words) == 1, one).when(F.size(words) == 2, join(F.lit("-"), month, day(of))).when(F.size(words) == 3, join(year(at(words, 2)), month, day(of)))

    words = F.when(first.isin(*WEEKDAYS) & (F.size(said) > 1), F.slice(said, 2, 4)).otherwise(said)
    return F.transform(F.array(words), read)[0]
