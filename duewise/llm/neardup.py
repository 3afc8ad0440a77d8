"""Near-duplicate classes by HyperMinHash.

1. A document's set is its distinct word shingles. Documents with equal sets form a class, known by its smallest id.
2. A class has ``REGISTERS`` registers, each for a hash function of its own. A register keeps the least hash as a count of
   leading zeros and the ten bits after the first one, 16 bits in all.
3. Bands of registers are keys; classes that share a key are candidates. The band width is the largest with which a pair at the
   threshold shares no band in fewer than 1 of 10^8 cases.
4. Within a band a class is compared with one class, drawn anew for each band, so a class meets many others and rows stay
   in proportion to classes. Candidates whose estimate, less expected collisions of compressed registers, is over
   ``ERRORS`` standard errors at the threshold below it go; the others are confirmed on their full sets.
   Confirmed links make components.
5. Then every class outside its band's main component meets all others of the band whose size fits, in tiles of at most two times
   ``TILE`` classes. A tile compares ``FINE`` further registers, the last eight bits of a least hash each, and lists for each class, in
   the first band that they share, those whose estimate is less than ``ERRORS`` standard errors below the threshold. The full sets of
   listed classes then come to the tile, which confirms pairs that nothing found so far connects and gives only these links, so rows
   follow classes and tiles, not pairs. A link inside a component needs no check, so no link between components is lost but those that
   the estimate misses, fewer than 1 in 10^6 exactly at the threshold and far fewer above it.

Only classes in shared bands have their sets kept, and only components, never all pairs of a group, are written.

Cases. Null texts count as empty; empty sets link with nothing, not even each other. With fewer words than a shingle has, the
whole sequence is the set. Repeated rows share a class. A row without an id belongs to the class of its equals, and if none of them has one
it stands alone. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import give_back, materialise, word_array
from duewise.llm.components import components
from duewise.llm.shingles import shingle_hashes, shingle_set

REGISTERS = 252
MANTISSA = 10
MISSED = 1e-8
ERRORS = 5
FINE = 768
TILE = 512
_COLLISION = 0.169919487159739  # limit of the chance that two compressed least hashes agree, times 2^MANTISSA

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)
_FINE_A = _rng.integers(0, 1 << 64, FINE, dtype=np.uint64) | np.uint64(1)
_FINE_B = _rng.integers(0, 1 << 64, FINE, dtype=np.uint64)


def band_width(threshold: float, registers: int = REGISTERS) -> int:
    fitting = [r for r in range(1, 33) if (1 - threshold**r) ** (registers // r) <= MISSED]
    return max(fitting, default=1)


def margin(threshold: float, registers: int, chance: float) -> float:
    """``ERRORS`` standard errors of an estimate at the threshold from registers of which ``chance`` agree anyway."""
    agree = threshold + (1 - threshold) * chance
    return float(ERRORS * np.sqrt(agree * (1 - agree) / registers) / (1 - chance))


def _least(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(found), 512):
        np.minimum(least, (found[i : i + 512, None] * a + b).min(axis=0), out=least)
    return least


def fine_registers(found: np.ndarray, width: int) -> bytes:
    """The last eight bits of further least hashes, and a digest of four bytes for each band."""
    least = _least(found, _FINE_A, _FINE_B)
    digests = shingle_rows(np.frombuffer(registers(found), "<u2")[: REGISTERS // width * width].reshape(-1, width).astype(np.uint64))
    return (least ^ (least >> np.uint64(32))).astype(np.uint8).tobytes() + digests.astype("<u4").tobytes()


def shingle_rows(rows: np.ndarray) -> np.ndarray:
    return np.array([shingle_hashes(r, len(r))[0] for r in rows], np.uint64)


def registers(found: np.ndarray) -> bytes:
    """Compressed registers of a set of hashes."""
    least = _least(found, _A, _B)
    exact = np.frexp(least.astype(np.float64))[1]  # may round up to the next power of two
    bits = np.where(exact > 64, 64, exact).astype(np.uint64)
    bits = np.where((bits > 0) & ((least >> (np.maximum(bits, 1) - np.uint64(1))) == 0), bits - np.uint64(1), bits)
    zeros = np.uint64(64) - bits
    shifted = least << np.minimum(zeros, np.uint64(63))
    mantissa = (shifted >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2").tobytes()


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeness from rows of registers, corrected for the registers expected to agree by chance."""
    agree = (a == b).mean(axis=1)
    n = np.maximum(size_a, size_b) / np.maximum(1, np.minimum(size_a, size_b))
    chance = _COLLISION * 4 * n / (1 + n) ** 2 / (1 << MANTISSA)
    return (agree - chance) / (1 - chance)


def _binary(column) -> list[bytes]:
    return column.to_pylist()


def sketches(docs: DataFrame, words: int, with_registers: bool) -> DataFrame:
    """doc_id, n_shingles, key (equal for equal sets, null for empty ones), registers (null if not asked for)."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py() or b"", words)
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                rows.append((doc_id, len(found), key, registers(found) if with_registers and len(found) else None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_shingles", "key", "registers"])
        give_back()

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, key binary, registers binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def shingle_sets(texts: DataFrame, words: int, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [shingle_set(t.as_py() or b"", words) for t in batch.column(1)]
            columns = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array([fine_registers(x, width) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "found", "fine"])
        give_back()

    return texts.mapInArrow(run, "node long, found binary, fine binary")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate is near the threshold or over it."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            matrix = {x: np.frombuffer(b"".join(_binary(cols[x])), "<u2").reshape(-1, REGISTERS) for x in ("r_a", "r_b")}
            size = {x: cols[x].to_numpy(zero_copy_only=False).astype(float) for x in ("n_a", "n_b")}
            keep = pa.array(estimate(matrix["r_a"], matrix["r_b"], size["n_a"], size["n_b"]) >= least)
            yield pa.RecordBatch.from_arrays([cols["a"].filter(keep), cols["b"].filter(keep)], ["a", "b"])
        give_back()

    least = threshold - margin(threshold, REGISTERS, _COLLISION / (1 << MANTISSA))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = F.least("n_a", "n_b") >= (threshold - 1e-9) * F.greatest("n_a", "n_b")
    return sized.where(fits).select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return bool(100 * both >= percent * (len(a) + len(b) - both))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are alike: 100 times the intersection is at least ``percent`` times the union."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("found").alias(f"s_{name}"))

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(_alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
        give_back()

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept, for every row."""
    threshold = percent / 100
    width = band_width(threshold)
    bands = REGISTERS // width
    made = materialise(sketches(docs, words, False).drop("registers"), "outlines")
    classes = materialise(
        sketches(docs, words, True).where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes"
    )
    known = classes.where("node IS NOT NULL")
    key = lambda i: F.xxhash64(i, F.substring("registers", i * 2 * width + 1, F.lit(2 * width)))
    every = known.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).alias("at", "band"))
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = materialise(every.join(shared, "band"), "bands")
    nodes = members.select("node").distinct()
    # the class's document holds the set; a repeated id may have several texts, so the set is looked up by key as well
    wanted = nodes.join(known.select("node", "key"), "node")
    texts = _texts(docs).join(wanted.select("node"), F.col("doc_id") == F.col("node")).select("node", "text")
    sets = materialise(_of_class(shingle_sets(texts, words, width), wanted), "sets")
    sized = materialise(_by_size(members.join(known.select("node", "n_shingles"), "node"), threshold), "sized")
    labels, links = nodes.select("node", F.col("node").alias("label")), None
    for last in (False, True):
        labelled = sized.join(labels, "node")
        by_label = labelled.groupBy("band", "bin", "label").agg(F.count(F.lit(1)).alias("n"))
        main = by_label.groupBy("band", "bin").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
        main = main.where("labels > 1").select("band", "bin", F.col("top.label").alias("main"), (F.col("all") - F.col("top.n")).alias("apart"), F.col("top.n").alias("together"))
        open_ = labelled.join(main, ["band", "bin"])
        if last:
            listed = _tiles(open_, known.select("node", "n_shingles").join(sets.select("node", "fine"), "node"), threshold)
            new = materialise(_links_of_tiles(materialise(listed, "likely"), sets, percent), "links")
        else:
            drawn = open_.groupBy("band", "bin").agg(F.min(F.struct(F.xxhash64("node", "band").alias("h"), F.col("node").alias("other"), F.col("label").alias("other_label"))).alias("d"))
            pairs = open_.join(drawn.select("band", "bin", "d.other", "d.other_label"), ["band", "bin"]).where("label <> other_label")
            pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
            new = materialise(_confirmed(materialise(_likely(pairs, known, threshold), "likely"), sets, percent), "links")
        links = new if links is None else links.unionAll(new)
        labels = materialise(nodes.join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    rows = made.select("doc_id", "n_shingles", "key")
    out = rows.join(classes.select("key", "node"), "key", "left").join(labels, "node", "left")
    component = F.coalesce("label", "node", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _by_size(members: DataFrame, threshold: float) -> DataFrame:
    """band, bin, node: bins of set size, each a factor of the threshold wide and half over the next, so that two sizes that fit share one."""
    bin_ = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-float(np.log(threshold))) + 1e-9).cast("int")
    placed = members.select("node", "band", "at", F.explode(F.array(bin_, bin_ + 1)).alias("bin"))
    shared = placed.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "bin")
    return placed.join(shared, ["band", "bin"])


_TILE = ["band", "bin", "i", "j"]


def _by_tile(batches):
    """Tiles of batches that are sorted by their first four columns: the key and the other columns, as lists."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        tiles = list(zip(*columns[:4], strict=True))
        cuts = [k for k in range(1, len(tiles)) if tiles[k] != tiles[k - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(tiles)], strict=True):
            if a == b:
                continue
            part = [c[a:b] for c in columns[4:]]
            if tiles[a] == key:
                held = [h + p for h, p in zip(held, part, strict=True)]
            else:
                if held:
                    yield key, held
                key, held = tiles[a], part
    if held:
        yield key, held


def _tiles(open_: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """band, bin, i, j, node, label, others: members of a tile in likely pairs with different labels, less pairs inside the main component.

    A pair is listed once, in ``others`` of one of its members.
    """
    blocks = lambda n: F.ceil(F.col(n) / TILE)
    main = F.col("label") == F.col("main")
    hashed = F.xxhash64("node", F.lit(99))
    block = F.when(main, blocks("apart") + F.pmod(hashed, F.greatest(blocks("together"), F.lit(1)))).otherwise(F.pmod(hashed, F.greatest(blocks("apart"), F.lit(1))))
    met = F.when(main, F.sequence(F.lit(0).cast("long"), blocks("apart") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), blocks("apart") + blocks("together") - 1))
    rows = open_.withColumn("block", block.cast("long")).withColumn("other", F.explode(met))
    rows = rows.select("band", "bin", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "at", "block", "node", "label")
    rows = rows.join(classes, "node")
    least = threshold - margin(threshold, FINE, 1 / 256)
    rows = rows.select(*_TILE, "at", "block", "node", "label", "n_shingles", "fine").repartition(*_TILE).sortWithinPartitions(*_TILE)

    def compare(at, bin_, block, node, label, size, fine):
        """Partners by row of a tile: all within one block, or those across two. A pair is left to the first band and the smaller bin that it shares."""
        digests, fine = np.ascontiguousarray(fine[:, FINE:]).view("<u4")[:, :at], fine[:, :FINE]
        found, one = {}, block.min() == block.max()
        bins = np.floor(np.log(size) / -np.log(threshold) + 1e-9).astype(np.int64)
        left = np.arange(len(node)) if one else np.flatnonzero(block == block.min())
        right = left if one else np.flatnonzero(block == block.max())
        for x in left:
            y = right[right > x] if one else right
            y = y[(label[y] != label[x]) & (np.maximum(bins[y], bins[x]) == bin_) & (np.minimum(size[y], size[x]) >= (threshold - 1e-9) * np.maximum(size[y], size[x]))]
            if not len(y):
                continue
            agree = (fine[y] == fine[x]).mean(axis=1)
            y = y[(agree - 1 / 256) / (1 - 1 / 256) >= least]
            y = y[~(digests[y] == digests[x]).any(axis=1)]
            if len(y):
                found[int(x)] = y
        return found

    def run(batches):
        for key, held in _by_tile(batches):
            if len(held[0]) < 2:
                continue
            at, block, node, label, size = (np.array(c, np.int64) for c in held[:5])
            found = compare(int(at[0]), key[1], block, node, label, size.astype(float), np.frombuffer(b"".join(held[5]), np.uint8).reshape(len(node), -1))
            if found:
                listed = np.unique(np.concatenate([np.array(list(found)), *found.values()]))
                others = [node[found[x]] if x in found else [] for x in listed.tolist()]
                keys = [pa.array([k] * len(listed), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(node[listed]), pa.array(label[listed]), pa.array(others, pa.list_(pa.int64()))], [*_TILE, "node", "label", "others"])
        give_back()

    return rows.mapInArrow(run, "band long, bin int, i long, j long, node long, label long, others array<long>")


def _links_of_tiles(listed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) that connect what the labels and the tile's earlier pairs do not connect: fewer than a tile's members."""

    def run(batches):
        for _, (node, label, others, found) in _by_tile(batches):
            full = {n: np.frombuffer(f, np.uint64) for n, f in zip(node, found, strict=True)}
            of, up = dict(zip(node, label, strict=True)), {x: x for x in label}

            def top(n, of=of, up=up):
                x = of[n]
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            links = []
            for a, partners in zip(node, others, strict=True):
                for b in partners:
                    x, y = top(a), top(b)
                    if x != y and _alike(full[a], full[b], percent):
                        up[max(x, y)] = min(x, y)
                        links.append((min(a, b), max(a, b)))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    rows = listed.join(sets.select("node", "found"), "node").select(*_TILE, "node", "label", "others", "found")
    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(run, "a long, b long")


def _of_class(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the sets under a repeated id, the one whose key the class has."""

    def run(batches):
        for batch in batches:
            keep = pa.array([hashlib.blake2b(f.as_py(), digest_size=16).digest() == k for f, k in zip(batch.column(1), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(3)], ["node", "found", "fine"])
        give_back()

    return sets.join(wanted, "node").select("node", "found", "fine", "key").mapInArrow(run, "node long, found binary, fine binary").dropDuplicates(["node"])


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, all columns: that with the smallest id, rows without an id after all others.

    Rows are told apart by a hash of id and text. Texts without words are in no group: all stay, but for repeats of an id.
    """
    rows = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    near = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words, percent).where("n_shingles > 0")
    groups = near.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = rows.select("_row", F.col("doc_id").cast("long").alias("_id")).distinct()
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))
    kept = groups.join(ids, "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    one = rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"])
    bare = rows.where(F.size(word_array(F.col("text").cast("string"))) == 0)
    bare = bare.where("doc_id IS NOT NULL").dropDuplicates(["_row"]).unionAll(bare.where("doc_id IS NULL"))
    return one.select(*docs.columns).unionAll(bare.select(*docs.columns))
