"""Best-two-fit packing of token sequences.

A document's ids, with an end id, are cut only if they are longer than a sequence; the last piece may be shorter. Pieces
are then packed into as few sequences as possible: fill a sequence greedily with the longest piece that fits, then replace
its smallest piece with two unpacked pieces that fit the expanded gap more tightly.

The choice depends on lengths only, and there are at most ``capacity`` of them. So Spark counts pieces by length, the driver
makes a plan over that histogram, whose size does not depend on the data, and Spark places the pieces: the plan says which
ranks of a length go to which run of sequences and at which offset. A plan step is a pattern of lengths repeated as often
as its lengths last. Ranks within a length are split by hash, so that a length that most pieces have is no hot key.

Cases. Null and empty texts give a piece that holds the end id only. Repeated rows give pieces of their own. Null ids are
kept. Columns other than those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import materialise
from duewise.llm.tokens import default_tokenizer, encoder, ids_crc32
from duewise.operators.prefix import chunked_rank

CAPACITY = 2048
END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bits of the hash by which ranks within a length are split.
RANK_BITS = 10


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text; ``with_ids`` adds their ids."""
    file = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in PIECE.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(file).stream(batch.column(1)), strict=True):
                ids = np.append(np.frombuffer(ids, encoder(file).dtype), end_id)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), ids_crc32(part), *([part.tolist()] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            kinds = types + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names + ["ids"] * with_ids)
        encoder(file).forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE + ", ids array<long>" * with_ids)


def _two(lengths: list[int], left: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two lengths left with the largest sum of at most ``room``; among equal sums, the one with the longest."""
    have = np.array([x for x in lengths if left[x] > 0 and x < room], dtype=np.int64)
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, side="right") - 1
    best = None
    sums = np.where(at >= 0, have + have[np.maximum(at, 0)], -1)
    for i in np.lexsort((-have, -sums)):
        if sums[i] < 0 or (best and sums[i] < sum(best)):
            break
        a, j = int(have[i]), int(at[i])
        while j >= 0 and int(have[j]) == a and left[a] < 2:
            j -= 1
        if j >= 0 and (best is None or a + int(have[j]) > sum(best)):
            best = (a, int(have[j]))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first sequence, offset) that place every piece of a histogram of lengths."""
    left = Counter({k: n for k, n in histogram.items() if n > 0})
    lengths = sorted(left)
    used: Counter = Counter()
    steps, sequence = [], 0
    while lengths:
        pattern, gap, taken = [], capacity, Counter()
        while gap:
            k = bisect_right(lengths, gap) - 1
            while k >= 0 and left[lengths[k]] - taken[lengths[k]] <= 0:
                k -= 1
            if k < 0:
                break
            pattern.append(lengths[k])
            taken[lengths[k]] += 1
            gap -= lengths[k]
        if gap and len(pattern) > 1:
            smallest = pattern[-1]
            free = {x: left[x] - taken[x] for x in lengths}
            two = _two(lengths, free, gap + smallest)
            if two and sum(two) > smallest:
                pattern[-1:] = two
                taken = Counter(pattern)
        times = min(left[x] // n for x, n in taken.items())
        offset = 0
        for x in pattern:
            steps.append((x, used[x], times, sequence, offset))
            used[x] += times
            left[x] -= times
            offset += x
        sequence += times
        lengths = [x for x in lengths if left[x] > 0]
    return steps


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``, keyed by doc_id and piece."""
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    steps = spark.createDataFrame(plan(counts, capacity), "length long, _first long, _times long, _sequence long, offset long")
    key = F.xxhash64("doc_id", "piece")
    ranked = chunked_rank(rows.withColumn("_key", key), ["length"], F.shiftright("_key", 64 - RANK_BITS), ["_key", "doc_id", "piece", "start", "ids_crc32"])
    rank = F.col("rank_in_key") - 1
    inside = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_times"))
    return (
        ranked.join(steps.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & inside)
        .withColumn("sequence_id", F.col("_sequence") + rank - F.col("_first"))
        .drop("_length", "_first", "_times", "_sequence", "_key", "rank_in_key", "n_in_key")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    made = materialise(pieces(docs, capacity, **options), "pieces")
    return pack(made, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The sequences themselves: sequence_id, ids. A group holds at most ``capacity`` ids."""
    made = materialise(pieces(docs, capacity, with_ids=True, **options), "pieces")
    parts = pack(made, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))
