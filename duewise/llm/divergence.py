"""How far the word use of sources lies apart, from bitmaps of equal counts.

Every kept term of a language has a number; 64 numbers in a row are a block. A source's terms of one block that it holds
equally often are one bitset: (source, count, block) with a 64-bit mask. For two sources, the AND of a mask of each, with its
bits counted, is the number of the block's terms that the first holds a times and the second b times; as a term's share
depends on its count alone, that number times the difference of two shares is all that these terms add. What a mask has left
over meets the other source's count zero, and the terms that neither holds are the complement of both. Numbers go by falling
total, so the terms of the long tail, which are nearly all, share a few counts a block.

Terms are counted in Python tasks that give partial counts whenever they hold ``HELD`` entries, and summed by (language,
term). Sources of a language are dealt into tiles of ``TILE``, blocks into slabs of ``SLAB``; a task meets two tiles over one
slab, so its rows are bounded and a language or source of any size is split. The result has a row for each pair of sources,
as asked. All arithmetic is on integers; shares are divided as decimals.

Cases. Null text, language or source counts as empty; an empty text adds its group and no terms. A row that repeats an id is a
document of its own. A language without kept terms has pairs with value 0 and no terms; a lone source has no pairs. A term or
source of any length is kept whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duewise.llm.common import materialise, utf8
from duewise.llm.ranks import ranked

LEAST_DOCUMENTS = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Entries a task holds before it gives its counts.
HELD = 200_000
BLOCK = 64
#: Blocks that a task meets at once, and sources of one tile.
SLAB, TILE = 256, 32

#: A to Z lower-cased, a to z and all bytes of other signs kept, everything else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str) -> list[bytes]:
    """All terms in order, as UTF-8: bytes of one sign are all kept or all blanks, so cutting bytes cuts between signs."""
    return utf8(text).translate(_FOLD).split()


def _partial(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    rows = [(lang, source, w, n, docs[w]) for (lang, source), (words, docs) in counts.items() for w, n in words.items()]
    rows += [(lang, source, None, 0, 0) for lang, source in counts]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_COUNTS)
    columns[2] = [None if w is None else w.decode("utf-8", "replace") for w in columns[2]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                found, before = terms(text.as_py()), len(words)
                words.update(found)
                docs.update(set(found))
                held += len(words) - before
                if held > most:
                    yield _partial(counts)
                    counts, held = {}, 0
        if counts:
            yield _partial(counts)

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences in the group), docs (documents of the language with the term); a null term for each group."""
    empty = F.lit("")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", "lang", "source")])
    partial = own.mapInArrow(_count(HELD), "lang string, source string, term string, n long, docs long")
    sums = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))


def _share(count: str, total: str, kept: str):
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact beyond 64 bits."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0))) div cast({total} + {PRIOR} * {kept} as decimal(20,0))"
    ).cast("long")


def _tile_sums(width: int):
    """Sum of differences over a slab for each pair of a source of the one tile and a later one of the other."""

    def run(key, rows):
        lang, slab, one, other = key
        held = {}
        for g, own in rows.sort_values(["g", "block"], kind="stable").groupby("g", sort=True):
            blank = own["block"].to_numpy() < 0
            bits = own["bits"].to_numpy(np.int64).view(np.uint64)[~blank]
            held[g] = (own["block"].to_numpy()[~blank], bits, own["p"].to_numpy(np.int64)[~blank], np.bitwise_count(bits).astype(np.int64), int(own["p"].to_numpy()[blank][0]))
        size, out = int(rows["terms"].iloc[0]), []
        for g, (g_blocks, g_bits, g_p, g_sizes, g_zero) in held.items():
            if g // width != one:
                continue
            for h, (h_blocks, h_bits, h_p, h_sizes, h_zero) in held.items():
                if h <= g or h // width != other:
                    continue
                lo, hi = np.searchsorted(h_blocks, g_blocks, "left"), np.searchsorted(h_blocks, g_blocks, "right")
                i = np.repeat(np.arange(len(g_blocks)), hi - lo)
                j = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                joint = np.bitwise_count(g_bits[i] & h_bits[j]).astype(np.int64)
                g_left, h_left = g_sizes.copy(), h_sizes.copy()
                np.subtract.at(g_left, i, joint)
                np.subtract.at(h_left, j, joint)
                neither = size - int(g_sizes.sum()) - int(h_left.sum())
                value = int((joint * np.abs(g_p[i] - h_p[j])).sum()) + int((g_left * np.abs(g_p - h_zero)).sum())
                value += int((h_left * np.abs(h_p - g_zero)).sum()) + neither * abs(g_zero - h_zero)
                out.append((lang, int(g), int(h), value))
        return pd.DataFrame(out, columns=["lang", "g", "h", "value"]).astype({"g": "int64", "h": "int64", "value": "int64"})

    return run


def pair_values(groups: DataFrame, held: DataFrame) -> DataFrame:
    """lang, g, h (g < h), value for all pairs of a language's sources.

    groups: lang, g (number of the source), p0 (share of a count of zero), kept (terms of the language). held: lang, g, idx (number
    of the term), n, p for the terms that a source holds.
    """
    masks = held.groupBy("lang", "g", F.expr(f"idx div {BLOCK}").alias("block"), "n", "p").agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(idx % {BLOCK} as int))")).alias("bits")
    )
    slabs = F.expr(f"greatest(1L, (kept + {BLOCK * SLAB - 1}) div {BLOCK * SLAB})")
    blank = groups.select("lang", "g", F.explode(F.sequence(F.lit(0).cast("long"), slabs - 1)).alias("slab"), F.lit(-1).cast("long").alias("block"), F.col("p0").alias("p"), F.lit(0).cast("long").alias("bits"))
    rows = masks.select("lang", "g", F.expr(f"block div {SLAB}").alias("slab"), "block", "p", "bits").unionByName(blank)
    tile = F.expr(f"g div {TILE}")
    langs = groups.groupBy("lang").agg(F.max(tile).alias("tiles"), F.max("kept").alias("kept"))
    rows = rows.join(langs, "lang").withColumn("terms", F.expr(f"least({BLOCK * SLAB}L, kept - slab * {BLOCK * SLAB})"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles"))))
    rows = rows.select("lang", "slab", F.least(tile, "_with").alias("one"), F.greatest(tile, "_with").alias("other"), "g", "block", "p", "bits", "terms")
    found = rows.groupBy("lang", "slab", "one", "other").applyInPandas(_tile_sums(TILE), "lang string, g long, h long, value long")
    return found.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value, rank: a source against each other one, and its own terms above the language's share."""
    counts = materialise(term_counts(docs), "term-counts")
    used = counts.where(F.col("term").isNotNull() & (F.col("docs") >= least)).select("lang", "source", "term", "n")
    totals = used.groupBy("lang", "term").agg(F.sum("n").alias("total"))
    numbered = materialise(ranked(totals.withColumn("_fall", -F.col("total")), "lang", ["_fall", "term"], "terms-dealt").drop("_fall", "n"), "terms")
    langs = numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_sum"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("group_sum"))
    groups = ranked(counts.where("term IS NULL").select("lang", "source"), "lang", ["source"], "groups-dealt").withColumnRenamed("idx", "g").drop("n")
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["kept", "lang_sum", "group_sum"])
    p0 = F.when(F.col("kept") > 0, _share("0", "group_sum", "greatest(kept, 1L)")).otherwise(0)
    groups = materialise(groups.withColumn("p0", p0), "groups")
    held = used.join(numbered, ["lang", "term"]).join(groups, ["lang", "source"]).withColumn("p", _share("n", "group_sum", "kept"))
    held = materialise(held.select("lang", "source", "g", "term", "idx", "n", "p", _share("total", "lang_sum", "kept").alias("q")), "held-terms")

    names = groups.select("lang", F.col("g"), "source")
    pairs = pair_values(groups, held)
    both = pairs.unionByName(pairs.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    both = both.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shown = ["lang", "source", "part", "item", "value", "rank"]
    both = both.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)}).select(*shown)
    above = held.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.unionByName(above.withColumn("part", F.lit("term")).select(*shown))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), o AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), n AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(s, 0) AS s, coalesce(v, 0) AS v, coalesce(t, 0) AS t FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS s FROM n GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS t FROM kept GROUP BY lang) USING (lang)
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (g.s + 5 * g.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (g.t + 5 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
    FROM c WHERE n > 0 AND p > q
  ) WHERE rank <= 50
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM rows
"""
