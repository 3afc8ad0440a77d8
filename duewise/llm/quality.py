"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over signs: case and punctuation stay, digits count as one sign, white space as one blank, and signs fold to
``BITS`` bits, so that a run of ``ORDER`` signs is one number. It is trained on trusted text, all labelled documents of good
quality; one in five of these, drawn by hash, is left out and sets the thresholds: a document of n signs is kept if its
perplexity is at most exp(``SPREAD`` / sqrt(n)) times the ``QUANTILE`` of these in its language. The factor allows for chance in
short texts.

Counts live in tables that Spark shards by run; nothing of the model is broadcast.

1. Documents are packed into blocks of some thousand rows, and each block lists its distinct runs. Labels meet
   the ids of blocks, and each block is told which of its rows to count; runs are added up in the task before they are shuffled.
2. The distinct runs of all blocks, order by order from one sign up, are joined with the counts of the run, the totals of its
   context and the probability of the run without its first sign, which gives the run's probability.
3. These go back to the blocks by a join on the run, and each block scores its documents.
4. Quantiles are exact, from running totals over distinct perplexities that are split by their logarithm.

What is shuffled is the packed blocks, twice, and their distinct runs, a small share of the text.

Cases. Null and empty texts have no perplexity and are rejected. Without a trusted text all probabilities are equal and, as
there is no threshold, all texts are kept. A language of which fewer than ``LEAST`` texts are left out has no threshold either and is
kept; null is a language of its own. Repeated rows and null ids are scored like others. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import give_back, materialise, utf8
from duewise.operators.prefix import before, chunked_prefix

ORDER = 4
BITS = 12
#: Fewest left-out texts that give a language a threshold.
LEAST = 10
QUANTILE = 0.99
SPREAD = 3.0
_SIZE = 1 << BITS
_START = 1
_PIECE = 1 << 18
_SLOTS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a block, and rows that go to Python, are packed and are unpacked together.
BLOCK_ROWS, ROWS_AT_ONCE = 10_000, 1000
#: Of zstd for packed blocks, as a trade of time for the size of two shuffles.
LEVEL = 9
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _symbols() -> np.ndarray:
    """A number for each sign of the first plane: itself where it fits, digits as 0, others folded into the upper half."""
    signs = np.arange(1 << 16, dtype=np.int64)
    out = np.where(signs < _SIZE, signs, _SIZE // 2 + signs % (_SIZE // 2))
    out[[i for i in range(1 << 16) if chr(i).isdigit()]] = ord("0")
    out[:2] = 2
    return out


_TABLE = _symbols()


def runs(text: str, order: int = ORDER) -> np.ndarray:
    """For each sign of a text, it and the ``order`` - 1 before it as one number."""
    signs = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "replace"), "<u4")
    if len(signs) and signs.max() >= 1 << 16:
        signs = np.where(signs < 1 << 16, signs, _SIZE // 2 + signs % (_SIZE // 2))
    padded = np.concatenate([np.full(order - 1, _START, np.int64), _TABLE[signs]])
    out = padded[: len(signs)].copy()
    for j in range(1, order):
        out <<= BITS
        out |= padded[j : j + len(signs)]
    return out


def _slot(run: np.ndarray) -> np.ndarray:
    return ((run.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOTS)).view(np.int64)


def distinct_runs(pieces) -> np.ndarray:
    """Ascending distinct runs of all pieces. A table by hash knows most runs that came before; the others are sorted."""
    table, parts, held = np.full(1 << _SLOTS, -1, np.int64), [np.empty(0, np.int64)], 0
    for piece in pieces:
        new = np.unique(piece[table[_slot(piece)] != piece])
        table[_slot(new)] = new
        parts.append(new)
        held += len(new)
        if held > _PIECE:
            parts = [np.unique(np.concatenate(parts))]
            held = 0
    return np.unique(np.concatenate(parts))


class Places:
    """Places of runs in an ascending array that holds them: most by a table, the rest by bisection."""

    def __init__(self, known: np.ndarray):
        self.known, self.table = known, np.zeros(1 << _SLOTS, np.int32)
        self.table[_slot(known)] = np.arange(len(known))

    def of(self, run: np.ndarray) -> np.ndarray:
        at = self.table[_slot(run)]
        other = np.flatnonzero(self.known[at] != run)
        at[other] = np.searchsorted(self.known, run[other])
        return at


def _pieces(texts, order: int):
    """Runs of many texts, some at a time."""
    group, held = [], 0
    for text in texts:
        if text:
            group.append(runs(text, order))
            held += len(group[-1])
        if held > _PIECE:
            yield np.concatenate(group)
            group, held = [], 0
    if group:
        yield np.concatenate(group)


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id, calibrates of the labelled good documents."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0)


def _counted(texts, order: int):
    """Batches of run, c for many texts, added up some signs at a time."""
    for piece in _pieces(texts, order):
        run, n = np.unique(piece, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(n.astype(np.int64))], ["run", "c"])


def trained_runs(blocks: DataFrame, good: DataFrame, order: int) -> DataFrame:
    """run, c over all rows whose document the model is trained on; only ids meet the labels."""
    each = blocks.select("block", F.posexplode("ids").alias("at", "doc_id"))
    rows = each.join(good.where("NOT calibrates").select("doc_id"), "doc_id").groupBy("block").agg(F.collect_list("at").alias("rows"))

    def wanted(batches):
        for batch in batches:
            for packed, at in zip(*batch.columns, strict=True):
                start, at = 0, np.sort(at.values.to_numpy())
                for rows in _unpacked(packed):
                    own = at[np.searchsorted(at, start) : np.searchsorted(at, start + rows.num_rows)] - start
                    yield from (t.as_py() for t in rows.column(2).take(pa.array(own)))
                    start += rows.num_rows

    def count(batches):
        yield from _counted(wanted(batches), order)
        give_back()

    return blocks.join(rows, "block").select("packed", "rows").mapInArrow(count, "run long, c long").groupBy("run").agg(F.sum("c").alias("c"))


def count_runs(texts: DataFrame, order: int) -> DataFrame:
    """run, c over a column of texts, added up in the task first."""

    def count(batches):
        for batch in batches:
            yield from _counted(batch.column(0).to_pylist(), order)

    return texts.mapInArrow(count, "run long, c long").groupBy("run").agg(F.sum("c").alias("c"))


class Counts:
    """For each order, counts of runs (plain at the highest order, numbers of different signs before it below) and totals of contexts, with discounts."""

    def __init__(self, table: DataFrame, order: int):
        """``table``: run, c of the highest order."""
        self.order, self.runs, self.contexts, self.discounts = order, {}, {}, {}
        for k in range(order, 0, -1):
            self.runs[k] = table = materialise(table, f"runs-{k}")
            of = table.select(*[F.count_if(F.col("c") == j) for j in (1, 2, 3, 4)]).first()
            self.discounts[k] = discounts(*of)
            n = lambda low, high=None: F.count_if((F.col("c") >= low) if high is None else F.col("c") == low)
            grouped = table.groupBy(F.shiftright("run", BITS).alias("context"))
            self.contexts[k] = materialise(grouped.agg(F.sum("c").alias("total"), n(1, 1).alias("n1"), n(2, 2).alias("n2"), n(3).alias("n3")), f"contexts-{k}")
            table = table.groupBy(F.col("run").bitwiseAND((1 << BITS * (k - 1)) - 1).alias("run")).agg(F.count(F.lit(1)).alias("c")) if k > 1 else table


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's estimates for counts of one, two, and three or more; 0.5, 1 and 1.5 where counts of counts do not give them."""
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k + 1 else (k + 1) / 2 for k, d in enumerate(found))


def probabilities(wanted: DataFrame, counts: Counts) -> DataFrame:
    """run, p for the distinct runs of the highest order in ``wanted``."""
    need = {counts.order: materialise(wanted.select("run").distinct(), "wanted")}
    for k in range(counts.order - 1, 0, -1):
        need[k] = need[k + 1].select(F.col("run").bitwiseAND((1 << BITS * k) - 1).alias("run")).distinct()
    lower = None
    for k in range(1, counts.order + 1):
        d1, d2, d3 = counts.discounts[k]
        rows = need[k].join(counts.runs[k], "run", "left").withColumn("context", F.shiftright("run", BITS))
        rows = rows.join(counts.contexts[k], "context", "left").drop("context")
        if lower is None:
            rows = rows.withColumn("p", F.lit(1.0 / _SIZE))
        else:
            rows = rows.withColumn("_lower", F.col("run").bitwiseAND((1 << BITS * (k - 1)) - 1))
            rows = rows.join(lower.select(F.col("run").alias("_lower"), "p"), "_lower").drop("_lower")
        c = F.coalesce("c", F.lit(0))
        less = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        left = (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((c - less) / F.col("total") + left * F.col("p"))
        lower = materialise(rows.select("run", p.alias("p")), f"probabilities-{k}")
    return lower


def _blocks(docs: DataFrame) -> DataFrame:
    """block, ids, packed documents (Arrow, its buffers under zstd), some thousand rows each, written."""

    def pack(batches):
        from pyspark import TaskContext

        number, held, ids = TaskContext.get().partitionId() << 31, None, []
        for batch in batches:
            if held is None:
                held = _Packed(batch.schema)
            held.add(batch)
            ids += batch.column(0).to_pylist()
            if len(ids) >= BLOCK_ROWS:
                yield _block(number, ids, held)
                number, held, ids = number + 1, None, []
        if held is not None:
            yield _block(number, ids, held)
        give_back()

    conf = docs.sparkSession.conf
    before_rows = conf.get(_ARROW_ROWS)
    conf.set(_ARROW_ROWS, str(ROWS_AT_ONCE))
    try:
        return materialise(docs.select("doc_id", "lang", "text").mapInArrow(pack, "block long, ids array<long>, packed binary"), "blocks")
    finally:
        conf.set(_ARROW_ROWS, before_rows)


def _block(number: int, ids: list, held: _Packed) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held.end()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "ids", "packed"])


class _Packed:
    """Batches that are compressed as they come, so that a block is never held as plain bytes."""

    def __init__(self, schema: pa.Schema):
        self.sink = pa.BufferOutputStream()
        self.out = pa.ipc.new_stream(self.sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL)))

    def add(self, batch: pa.RecordBatch) -> None:
        self.out.write_batch(batch)

    def end(self) -> bytes:
        self.out.close()
        return self.sink.getvalue().to_pybytes()


def _unpacked(packed):
    """The batches of a block, some rows at a time."""
    yield from pa.ipc.open_stream(packed.as_buffer())


def perplexities(docs: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, lang, n_signs, perplexity (null without signs) of all rows of (doc_id, lang, text)."""
    return block_perplexities(_blocks(docs), counts).drop("digest")


def block_perplexities(blocks: DataFrame, counts: Counts) -> DataFrame:
    order = counts.order

    def distinct(batches):
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = distinct_runs(_pieces((t.as_py() for rows in _unpacked(packed) for t in rows.column(2)), order))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), block))], ["run", "block"])
        give_back()

    listed = materialise(blocks.select("block", "packed").mapInArrow(distinct, "run long, block long"), "block-runs")
    known = probabilities(listed, counts)
    tables = listed.join(known, "run").groupBy("block").agg(F.collect_list("run").alias("runs"), F.collect_list("p").alias("ps"))

    def score(batches):
        for batch in batches:
            for packed, run, p in zip(*batch.columns, strict=True):
                run, p = run.values.to_numpy(), p.values.to_numpy()
                by = np.argsort(run)
                places, log = Places(run[by]), np.log(p[by])
                for got in _unpacked(packed):
                    n, out, digests = [], [], []
                    for text in got.column(2):
                        text = text.as_py()
                        each = runs(text, order) if text else np.empty(0, np.int64)
                        n.append(len(each))
                        out.append(float(np.exp(-log[places.of(each)].mean())) if len(each) else None)
                        digests.append(None if text is None else hashlib.md5(utf8(text)).hexdigest())
                    columns = [got.column(0), got.column(1), pa.array(digests, pa.string()), pa.array(n, pa.int64()), pa.array(out, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "digest", "n_signs", "perplexity"])
        give_back()

    empty = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    joined = blocks.select("block", "packed").join(tables, "block", "left").select("packed", F.coalesce("runs", empty[0]).alias("runs"), F.coalesce("ps", empty[1]).alias("ps"))
    return joined.mapInArrow(score, "doc_id long, lang string, digest string, n_signs long, perplexity double")


def thresholds(held: DataFrame, quantile: float, least: int = LEAST) -> DataFrame:
    """lang, limit: the exact quantile of (lang, perplexity), linear between neighbours, of each language with ``least`` rows or more."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # a join key without nulls
    distinct = held.groupBy(lang.alias("_lang"), "perplexity").agg(F.count(F.lit(1)).alias("n"))
    distinct = materialise(distinct.withColumn("_chunk", F.floor(F.log("perplexity") * 1000)), "held")
    total = distinct.groupBy("_lang").agg(F.sum("n").alias("_all")).where(F.col("_all") >= least)
    at = quantile * (F.col("_all") - 1)
    holds = lambda i: ((F.col(before("n")) <= i) & (i < F.col(before("n")) + F.col("n"))).cast("int")
    share = holds(F.floor(at)) * (1 - (at - F.floor(at))) + holds(F.floor(at) + 1) * (at - F.floor(at))
    placed = chunked_prefix(distinct, ["_lang"], "perplexity", "_chunk", ["n"]).join(total, "_lang")
    limits = placed.groupBy("_lang").agg(F.sum(F.col("perplexity") * share).alias("limit"))
    return limits.select(F.when(F.col("_lang") != "", F.substring("_lang", 2, 1 << 30)).alias("lang"), "limit")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """doc_id, lang, n_signs, perplexity, threshold (null if the language has none), kept of every row."""
    return _classified(docs, labels, order, quantile, spread, least).drop("digest")


def _classified(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """``classify`` with digest, the md5 of the text: language and text decide, whatever the id."""
    good = trusted(labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(rows)
    counts = Counts(trained_runs(blocks, good, order), order)
    scored = materialise(block_perplexities(blocks, counts), "perplexities")
    held = scored.join(good.where("calibrates").select("doc_id"), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    limits = materialise(thresholds(held, quantile, least), "thresholds").withColumnRenamed("lang", "_lang")
    limit = F.col("limit") * F.exp(spread / F.sqrt(F.greatest("n_signs", F.lit(1))))
    fine = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", limit)
    return joined.drop("_lang", "limit").withColumn("kept", fine)


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are kept, all columns; rows that repeat an id or have none are judged one by one, by their language and text."""
    gone = _classified(docs, labels, **options).where("NOT kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("_lang"),
        F.coalesce("digest", F.lit("")).alias("_digest"),
    ).distinct()
    same = [
        F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")) == gone["_id"],
        F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit("")) == gone["_lang"],
        F.coalesce(F.md5(docs["text"].cast("string").cast("binary")), F.lit("")) == gone["_digest"],
    ]
    return docs.join(gone, same, "left_anti")
