"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

A text's words are hashed, and each run of `shingle` words is hashed once, from
its words' hashes. A hash's high part is its bin, and each bin keeps its least
hash. Sorting the hashes puts every bin's least one first in its run, so one
sort and one filter find them all. An empty bin takes the value of the
non-empty bin that comes first in the empty bin's own random order of bins,
the same for every document (optimal densification: each empty bin probes
bins on its own until one has a value; here the first hit is found as the
least hash of (empty bin, bin)). The fingerprint keeps the `bits` low-order
bits of each bin, packed in hexadecimal digits. Two random values agree with
probability 2^-bits, so the likeness is the share of agreeing bins, corrected:
(share - c) / (1 - c), c = 2^-bits, not below 0.

All of it is one expression of built-in functions a row: no Python and no
shuffle.

Defined results: a null text counts as empty; a text with fewer words than a
shingle has one shingle, all its words; a text without words has the empty
fingerprint, whose likeness is 1 to itself and 0 to any other; equal texts
have equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import WORD, checkpointed, let, text_of

#: Documents of a bucket, about; buckets at most; buckets up to which their first rows are broadcast (with their texts); beyond, they are joined.
BUCKET_ROWS, MOST_BUCKETS, BROADCAST_BUCKETS = 1000, 65_536, 2048


def fingerprint(text: Column, bins: int = 128, bits: int = 8, shingle: int = 5) -> Column:
    """Hexadecimal fingerprint of bins * bits / 4 digits; bins: a power of two; bits: 4, 8, 12 or 16."""
    if bins & (bins - 1) or bits not in (4, 8, 12, 16):
        raise ValueError("bins must be a power of two, bits 4, 8, 12 or 16")
    digits, away = bits // 4, 64 - bins.bit_length() + 1
    bin_of = lambda h: F.shiftright(h, away) + F.lit(bins // 2)  # noqa: E731  the signed order of hashes is that of their bins
    low = lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(2**bits - 1)))), digits, "0")

    def shingles(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))
        return F.when(n >= shingle, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    def packed(least: Column) -> Column:
        """least: the least hash of each bin that has one, in order of bins."""
        full = F.concat(*[F.array_join(F.transform(least, low), "")])

        def densified(held: Column) -> Column:
            fill = lambda i: F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(i, bin_of(h)).alias("order"), h.alias("h"))))["h"]
            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: let(F.array_position(held, i), lambda at: low(F.when(at > 0, F.get(least, (at - 1).cast("int"))).otherwise(fill(i))))), "")

        return F.when(F.size(least) == bins, full).when(F.size(least) == 0, F.lit("")).otherwise(let(F.transform(least, lambda h: bin_of(h).cast("int")), densified))

    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    least = lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))
    return let(words, lambda w: let(F.sort_array(shingles(w)), lambda s: let(least(s), packed)))


def likeness(a: Column, b: Column, bins: int = 128, bits: int = 8) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    digits, c = bits // 4, 2.0**-bits
    same = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), lambda n, i: n + (F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))).cast("int"))
    found = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - c) / (1 - c))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(found)


def followed(docs: DataFrame, id_col: str, text_col: str, results: dict[str, Column] | None = None) -> DataFrame:
    """id, text, the results, and next_text and next_<result> of the next row in descending order of id (after the last: the first).

    Rows meet in buckets, which are ranges of ids between quantiles, and only the last of a bucket needs
    another bucket's first row; those are one row a bucket, and are broadcast or joined by bucket. Null ids come last, rows repeating an id in order of text.
    """
    results = results or {}
    n = docs.count()
    parts = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds = sorted(set(docs.stat.approxQuantile(id_col, [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 and n else []))
    ids = F.col(id_col)
    # two steps of about sqrt(parts) comparisons
    step = max(1, int(len(bounds) ** 0.5))
    numbers = lambda xs: F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>") if xs else F.array().cast("array<double>")  # noqa: E731  a constant
    below = lambda xs: F.size(F.filter(xs, lambda x: x < ids))
    fine = lambda c: below(F.slice(numbers(bounds), (c * step + 1).cast("int"), F.lit(step)))
    bucket = F.when(ids.isNull(), F.lit(-1)).otherwise(let(below(numbers(bounds[step - 1 :: step])), lambda c: c * step + fine(c)))
    rows = docs.select(ids.alias("__id"), text_of(text_col).alias("text"), bucket.alias("__bucket"))

    order = F.struct(F.col("__id").isNull(), -F.col("__id"), F.col("text"))
    firsts = rows.groupBy("__bucket").agg(F.min_by("text", order).alias("text"))
    firsts = firsts.select("__bucket", "text", *[c.alias(k) for k, c in results.items()])
    ring = Window.partitionBy(F.lit(0)).orderBy(F.col("__bucket").desc())
    # lead() past the lowest bucket comes round to the highest: one row a bucket
    kept = ["text", *results]
    firsts = firsts.select(F.col("__bucket").alias("__b"), *[F.coalesce(F.lead(k).over(ring), F.first(k).over(ring)).alias(f"__first_{k}") for k in kept])
    firsts = checkpointed(firsts)

    by = Window.partitionBy("__bucket").orderBy(F.col("__id").desc_nulls_last(), F.col("text"))
    rows = rows.select("*", *[c.alias(k) for k, c in results.items()])
    rows = rows.withColumns({f"__next_{k}": F.lead(k).over(by) for k in kept})
    rows = rows.join(F.broadcast(firsts) if parts <= BROADCAST_BUCKETS else firsts, F.col("__bucket") == F.col("__b"), "left")
    return rows.select(F.col("__id").alias(id_col), *kept, *[F.coalesce(f"__next_{k}", f"__first_{k}").alias(f"next_{k}") for k in kept])


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = 128, bits: int = 8, shingle: int = 5) -> DataFrame:
    """Fingerprints of each text and of the text whose last half is overwritten by the next one's beginning, and their likeness."""
    rows = followed(docs, id_col, text_col, {"fingerprint": fingerprint(F.col("text"), bins, bits, shingle)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("__edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumns({"edited_sha256": F.sha2("__edited", 256), "edited_fingerprint": fingerprint(F.col("__edited"), bins, bits, shingle)})
    return rows.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins, bits).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), bins, bits).alias("near_next"))
