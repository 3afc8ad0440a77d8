"""Substring dedup: repeated runs of words, found as compacted paths of a De Bruijn graph.

A window of ``WINDOW`` words is an edge between its first and last ``WINDOW - 1`` words. Words covered by a window that also starts
earlier (smaller id, or the same document and an earlier start) are removed. Rows are told apart by a hash of id and text: of different
texts under one id, or without an id, the one with the smaller hash is earlier.

1. Whole copies. A document with the words of an earlier one loses all words that a window covers; only the first of each
   such group goes on.
2. Seeds. In every window the ``SEED``-word run with the least hash is marked, so equal windows hold equal seeds, and about one word
   in eight begins one. Counting seeds, added up before the shuffle, and joining them back tells which documents may
   hold repeated windows, and where. No other window is ever written.
3. Edges. The windows around repeated seeds are counted; each edge keeps its multiplicity and its source, the smallest
   (id, start). These are grouped minima, so a passage in a third of all documents is one row for each task.
4. Compaction. Edges whose sources follow each other in a document and whose multiplicity does not change form one path: where a
   path branches, occurrences leave or join and the multiplicity changes.
5. Verification. Each document gets the paths whose source lies in it. A seeded window that is on none of them has an earlier
   source, so the words it covers go.

Texts are shuffled once, with the documents that may hold repeats written down for the last step.

Cases. Null and empty texts have no words. Texts shorter than a window stay whole. A row without an id comes after all others;
of equal ones one is first and the others are whole copies. Repeated rows (same id and text) get the same result. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duewise.llm.common import materialise
from duewise.llm.shingles import shingle_hashes, text_hashes

WINDOW = 20
SEED = 6
ROWS_AT_ONCE = 200_000
#: Stands for a null id, so that it sorts last.
LAST = (1 << 63) - 1


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _hashes_of(texts: pa.Array):
    return text_hashes(text.as_py() or b"" for text in texts)


def seeds(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seed-long runs, and for each window the place of its least one (the first, if several)."""
    runs = shingle_hashes(hashes, seed)
    least, at, have, wide = runs, np.arange(len(runs)), 1, window - seed + 1
    while have < wide:  # the least of a stretch from those of two shorter ones, the left one if equal
        step = min(have, wide - have)
        right = least[step:] < least[:-step]
        least, at, have = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step]), have + step
    return runs, at


def _outlines(rows: DataFrame) -> DataFrame:
    """Per row: id, hash of id and text, key of its word sequence, number of words, sha256 of the words joined by blanks."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2):
                words = (text.as_py() or b"").split()
                joined = b" ".join(words)
                out.append((hashlib.blake2b(joined, digest_size=16).digest(), len(words), hashlib.sha256(joined).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            kinds = (pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "row", "key", "n_words", "sha"])

    return rows.select("id", "row", "text").mapInArrow(run, "id long, row long, key binary, n_words long, sha string")


def _seeds_of(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """seed, row: each document's distinct seeds, twice if at several places."""

    def run(batches):
        for batch in batches:
            ids, found, held = [], [], 0
            for doc, hashes in zip(batch.column(0).to_pylist(), _hashes_of(batch.column(1)), strict=True):
                if len(hashes) < window:
                    continue
                runs, at = seeds(hashes, window, seed)
                value, times = np.unique(runs[at[np.diff(at, prepend=-1) > 0]], return_counts=True)
                found.append(np.repeat(value, np.minimum(times, 2)).view(np.int64))
                ids.append(np.full(len(found[-1]), doc, np.int64))
                held += len(found[-1])
                if held > ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], ["seed", "row"])
                    ids, found, held = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], ["seed", "row"])

    return rows.select("row", "text").mapInArrow(run, "seed long, row long")


def _seeded(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """id, row, text, ranges (from, to, from, to ... of starts of windows whose seed is repeated)."""

    def run(batches):
        for batch in batches:
            keep, ranges = [], []
            for hashes, found in zip(_hashes_of(batch.column(2)), batch.column(3), strict=True):
                repeated = np.zeros(0, bool)
                if len(hashes) >= window:
                    runs, at = seeds(hashes, window, seed)
                    repeated = np.isin(runs[at], found.values.to_numpy().view(np.uint64))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
                keep.append(len(edges) > 0)
                ranges.append(edges)
            out = [batch.column(0), batch.column(1), batch.column(2), pa.array(ranges, pa.list_(pa.int64()))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], ["id", "row", "text", "ranges"])

    return texts.mapInArrow(run, "id long, row long, text binary, ranges array<long>")


def _starts(ranges: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(a, b) for a, b in ranges.reshape(-1, 2)]) if len(ranges) else np.empty(0, np.int64)


def _edges(seeded: DataFrame, window: int) -> DataFrame:
    """edge, id, row, start of every seeded window."""

    def run(batches):
        names = ["edge", "id", "row", "start"]
        for batch in batches:
            parts, held = [], 0
            for doc, row, hashes, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _hashes_of(batch.column(2)), batch.column(3), strict=True):
                starts = _starts(ranges.values.to_numpy())
                edges = shingle_hashes(hashes, window)[starts].view(np.int64)
                parts.append((edges, np.full(len(starts), doc, np.int64), np.full(len(starts), row, np.int64), starts.astype(np.int32)))
                held += len(starts)
                if held > ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    return seeded.select("id", "row", "text", "ranges").mapInArrow(run, "edge long, id long, row long, start int")


def paths(edges: DataFrame) -> DataFrame:
    """id, row, first, last (starts of windows), n: maximal runs of edges with sources in a row and the same multiplicity."""
    counted = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "start")).alias("source"))
    placed = counted.select("source.id", "source.row", "source.start", "n")
    along = Window.partitionBy("id", "row").orderBy("start")  # one document's edges
    before = F.lag(F.struct("start", "n")).over(along)
    broken = F.coalesce(F.when((before["start"] == F.col("start") - 1) & (before["n"] == F.col("n")), 0), F.lit(1))
    run = F.sum("_broken").over(along)
    return placed.withColumn("_broken", broken).withColumn("_path", run).groupBy("id", "row", "_path").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.first("n").alias("n")).drop("_path")


def _kept(seeded: DataFrame, window: int) -> DataFrame:
    """row, n_removed, sha after removal, given each document's own paths."""

    def run(batches):
        for batch in batches:
            removed, shas = [], []
            for text, ranges, own in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().split()
                later = np.zeros(max(0, len(words) - window + 1), np.int8)
                later[_starts(ranges.values.to_numpy())] = 1
                for path in own.as_py() or ():
                    later[path["first"] : path["last"] + 1] = 0
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(later)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                shas.append(_sha([w for w, g in zip(words, gone, strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["row", "removed", "left"])

    return seeded.select("row", "text", "ranges", "own").mapInArrow(run, "row long, removed long, left string")


def _prepared(docs: DataFrame, window: int, seed: int):
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    outlines = materialise(_outlines(rows).withColumn("at", F.monotonically_increasing_id()), "outlines")
    firsts = outlines.groupBy("key").agg(F.min(F.struct("id", "row", "at")).alias("first"))
    copy = (F.col("id") > F.col("first.id")) | (F.col("row") != F.col("first.row")) | ((F.col("id") == LAST) & (F.col("at") != F.col("first.at")))
    marked = materialise(outlines.join(firsts, "key").withColumn("copy", copy).drop("first", "at"), "outlines")
    found = _seeds_of(rows, window, seed)
    repeated = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    touched = found.join(repeated, "seed", "left_semi").groupBy("row").agg(F.collect_set("seed").alias("found"))
    own = marked.where(~F.col("copy") & (F.col("n_words") >= window)).select("row").distinct()
    wanted = materialise(touched.join(own, "row", "left_semi"), "touched")
    texts = rows.where("text IS NOT NULL").join(wanted, "row").select("id", "row", "text", "found")
    return marked, materialise(_seeded(texts, window, seed), "seeded")


def deduplicated_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    marked, seeded = _prepared(docs, window, seed)
    own = paths(_edges(seeded, window)).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("own"))
    result = _kept(seeded.join(own, "row", "left"), window).dropDuplicates(["row"])
    out = marked.join(result, "row", "left")
    whole = F.col("copy") & (F.col("n_words") >= window)
    return out.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The compacted paths that repeat, whole copies left aside: doc_id and words (from, to; end exclusive) of the source, occurrences."""
    _, seeded = _prepared(docs, window, seed)
    found = paths(_edges(seeded, window)).where("n > 1")
    return found.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), F.col("first").alias("from"), (F.col("last") + window).alias("to"), F.col("n").alias("occurrences"))
