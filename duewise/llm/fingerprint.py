"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending list of the k smallest distinct 64-bit hashes of a text's five-word shingles, moved to 0 to 2^63 - 1.
Sketches merge: the k smallest of a union of sketches are the sketch of the union, so parts of a text or a corpus can be
sketched apart. Two sketches give the resemblance (share of both in the k smallest of their union), the containment of one in
the other and the number of distinct shingles ((k - 1) / k-th smallest as a share of the range; exact below k shingles).

Words are as they stand in the text. A text with fewer than five words is one shingle, the whole sequence; without words
the sketch is empty. Two empty sketches resemble each other with 1, an empty and another with 0.

Neighbours. A document's next one has the next smaller id. Quantiles of the ids, which are ids themselves, cut the table
into ranges; each range is a window of its own, and the document at the top of a range also goes, as a guest, to the range above,
so the texts are shuffled once. The last document's next is the first.

Cases. Null texts count as empty. Null ids come after all others. Equal ids stand in descending order of text. If no row has
an id, the last row has an empty text after it. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewise.llm.common import word_array

K = 128
WORDS = 5
RANGE_BYTES = 32 << 20
#: Ranges of ids: at least and at most.
MIN_RANGES, MAX_RANGES = 64, 100_000
TOP = float(1 << 63)


def hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct hashes of a text's shingles."""

    def of(w: Column) -> Column:
        start = lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, words)])
        many = F.slice(F.transform(w, start), 1, F.greatest(F.size(w) - words + 1, F.lit(0)))
        one = F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, one).otherwise(none)

    bound = F.transform(F.array(word_array(text)), of)  # binds the words, which are then made once
    return F.array_distinct(F.transform(bound[0], lambda h: F.shiftrightunsigned(h, 1)))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(hashes(text, words)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: Column, k: int = K) -> Column:
    """Of an array of sketches."""
    return F.aggregate(sketches, F.array().cast("array<bigint>"), lambda a, b: merge(a, b, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union)).cast("double")


def distinct_shingles(s: Column, k: int = K) -> Column:
    last = F.element_at(s, -1).cast("double")
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / ((last + 1) / F.lit(TOP)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has: resemblance times the size of the union over the size of a."""
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(share, F.lit(1.0))).cast("double")


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _ranges(docs: DataFrame) -> tuple[Column, Column, int]:
    """The number of an id's range, whether the id is the top of it, and how many ranges there are.

    Only the quantiles come to the driver, at most ``MAX_RANGES``; a row looks its range up in two steps of their square root.
    """
    size, high = docs.agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    if high is None:
        return F.lit(0), F.lit(False), 1
    n = min(MAX_RANGES, max(MIN_RANGES, -(-(size or 0) // RANGE_BYTES)))
    found = docs.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], 10 * n)).first()[0]
    tops = sorted({*found, high})
    width = math.isqrt(len(tops) - 1) + 1
    groups = [tops[i : i + width] for i in range(0, len(tops), width)]
    last = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    nested = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    below = lambda bounds: F.size(F.filter(bounds, lambda t: t < F.col("doc_id")))
    group = below(last)
    inside = below(F.get(nested, group))
    return F.coalesce(group * width + inside, F.lit(0)), F.coalesce(F.get(F.get(nested, group), inside) == F.col("doc_id"), F.lit(False)), len(tops)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, and a row's place: _range, _guest, _row. Guests stand for the first row of the range below."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own, top, n = _ranges(rows)
    rows = rows.withColumn("_own", own).withColumn("_top", top)
    places = F.when(F.col("_top"), F.array(F.struct(F.col("_own").alias("r"), F.lit(0).alias("g")), F.struct(((F.col("_own") + 1) % n).alias("r"), F.lit(1).alias("g"))))
    rows = rows.withColumn("_place", F.explode(places.otherwise(F.array(F.struct(F.col("_own").alias("r"), F.lit(0).alias("g"))))))
    rows = rows.select("doc_id", "text", F.col("_place.r").alias("_range"), F.col("_place.g").alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    return rows.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("_row", F.row_number().over(order))


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and what the sketches also tell: n_shingles, contained_in_edited.

    The edited text is the text with its last third replaced by the beginning of the next one.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_cut")), F.substring("next_text", F.lit(1), F.col("_cut"))))
    made = rows.select(
        "_range", "_guest", "_row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k, words).alias("own"), sketch(F.col("edited"), k, words).alias("edit")
    )
    follows = F.lead("own").over(Window.partitionBy("_range").orderBy("_row"))
    out = made.withColumn("next", F.coalesce(follows, F.array().cast("array<bigint>"))).where("_guest = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edit"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"), containment(F.col("own"), F.col("edit"), k).alias("contained_in_edited"),
    )
