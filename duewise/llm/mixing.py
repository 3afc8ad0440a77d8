"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, linear between knots. Its integral is the source's weight.
Weights share the words of the mix (``share`` times all words); a target stops at ``epochs`` times its source's words and the
excess goes to the others by weight. With C the capped targets and W the weights of a source and all that follow in
ascending order of cap over weight, the level at which nobody is above is the largest (total - C before) / W.

A source's demand up to time u is its target times its schedule's share of area up to u. Its documents stand in an order
by hash, epoch after epoch; the word at count c is wanted when demand reaches c, so inverting the demand gives each copy of a
document its training position. The copies are range-sorted by position. A source's last copy is taken in part if the
target ends inside it, so taken words meet the target to the word.

Running totals within a source are split by hash prefix, so that a source with a third of all documents is no hot key.

Cases. Null texts have no words. A null source is a source of its own, after all others. Repeated rows are documents of
their own. Null ids are kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewise.llm.common import materialise, word_array
from duewise.operators.prefix import before, chunked_prefix, chunked_rank

SHARE = 1.5
EPOCHS = 2
#: Knots (time, weight) of the schedules that sources take in turn; their areas are 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
SEGMENT = "array<struct<area:double,u:double,w:double,slope:double>>"


def segments(knots) -> list[tuple[float, float, float, float]]:
    """Per piece: area before it, its start, the weight there, the slope."""
    out, area = [], 0.0
    for (u0, w0), (u1, w1) in zip(knots, knots[1:], strict=False):
        out.append((area, float(u0), float(w0), (w1 - w0) / (u1 - u0)))
        area += (u1 - u0) * (w0 + w1) / 2
    return out


def area(knots) -> float:
    return sum((u1 - u0) * (w0 + w1) / 2 for (u0, w0), (u1, w1) in zip(knots, knots[1:], strict=False))


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """One row for each source of (source, size): source_no, source_size, weight, target, schedule. There is one row a source here, however many documents it has."""
    spark = sizes.sparkSession
    weights = spark.createDataFrame(
        [(k, float(area(s)), segments(s)) for k, s in enumerate(schedules)], f"_turn long, weight double, schedule {SEGMENT}"
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(by_name).cast("long"))
    sources = sources.withColumn("_turn", (F.col("source_no") - 1) % len(schedules)).join(weights, "_turn").withColumn("_cap", epochs * F.col("source_size"))
    order = [F.col("_cap") / F.col("weight"), F.col("source_no")]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(Window.partitionBy()).cast("double")
    levels = sources.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))) / F.sum("weight").over(rest))
    level = F.max("_level").over(Window.partitionBy())
    return levels.withColumn("target", F.least(level * F.col("weight"), F.col("_cap").cast("double"))).select(
        "source", "source_no", "source_size", "weight", "target", "schedule"
    )


def position(count: Column) -> Column:
    """Training time at which a source's demand reaches ``count`` words."""
    wanted = count / F.col("target") * F.col("weight")
    piece = F.element_at(F.filter("schedule", lambda s: s["area"] <= wanted), -1)
    rest = wanted - piece["area"]
    # Where a schedule begins at weight 0, nothing is left over and nothing is divided by.
    return piece["u"] + F.coalesce(F.try_divide(2 * rest, piece["w"] + F.sqrt(piece["w"] * piece["w"] + 2 * piece["slope"] * rest)), F.lit(0.0))


def word_sizes(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(word_array(F.col("text"))).cast("long").alias("size"))


def mix(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, schedules=SCHEDULES, tie: str | None = None) -> DataFrame:
    """Adds source_size, target, taken (words, all epochs), takes (array of words by epoch) and position (of the first copy, null if none) to doc_id, source, size.

    ``tie``, a column of distinct texts, orders rows of the same id and size and spreads those without an id.
    """
    sources = targets(sizes, share, epochs, schedules)
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    mixed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col(tie) if tie else F.lit("")))
    rows = rows.withColumn("_order", F.struct(mixed.alias("hash"), F.col("size"), *([F.col(tie)] if tie else []))).withColumn("_chunk", F.substring(mixed, 1, 3))
    placed = chunked_prefix(rows, ["source_no"], "_order", "_chunk", ["size"])
    demand = F.floor(F.col("target") + 0.5)
    takes = [
        F.greatest(F.lit(0), F.least(F.col("size"), demand - e * F.col("source_size") - F.col(before("size")))) for e in range(epochs)
    ]
    return (
        placed.withColumn("takes", F.array(*takes))
        .withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("position", F.when(F.col("taken") > 0, position(F.col(before("size")))))
        .drop("_order", "_chunk")
    )


def copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, with its words and training position, range-sorted by position."""
    each = mixed.select("*", F.posexplode("takes").alias("epoch", "words")).where("words > 0")
    at = position(F.col("epoch") * F.col("source_size") + F.col(before("size")))
    return each.select("doc_id", "source", "size", "epoch", "words", at.alias("position")).orderBy("position", "source", "doc_id", "epoch")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of all documents, range-sorted by position."""
    sizes = materialise(word_sizes(docs), "word-sizes")
    return mix(sizes, **options).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, a row for each copy of which it takes at least half; all columns of ``docs``.

    Every row counts and is decided by itself. Rows are ordered by id, hash of the text and number among equals, so the result does
    not depend on how they are dealt out.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    sizes = word_sizes(rows, F.col("_row"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_content"))
    equal = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_content", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ranked = chunked_rank(sizes.withColumn("_equal", F.md5(equal)), ["_equal"], F.shiftright("_row", 33), [F.col("_row")])
    sizes = materialise(ranked.select("_row", "doc_id", "source", "size", F.concat_ws(" ", "_equal", "rank_in_key").alias("_tie")), "word-sizes")
    chosen = mix(sizes, tie="_tie", **options).select("_row", F.size(F.filter("takes", lambda x: 2 * x >= F.greatest(F.col("size"), F.lit(1)))).alias("_copies"))
    kept = chosen.where("_copies > 0")
    return rows.join(kept, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    CASE (no - 1) % 3 WHEN 0 THEN 6.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
    CASE (no - 1) % 3 WHEN 0 THEN -2.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope
  FROM by_source
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / sum(weight) OVER (ORDER BY 2 * source_size / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT *, least(max(level) OVER () * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, t.w0, t.slope,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY t.no ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - c)) + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - source_size - c)) AS taken
  FROM placed
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(0.0 + 2 * (c / target * weight) / (w0 + sqrt(w0 * w0 + 2 * slope * (c / target * weight))), 6) END AS position
FROM taken
"""
