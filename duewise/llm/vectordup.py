"""Links between vectors of one label by collision counting over one-dimensional projections.

Vectors have length 1 here, so cosine >= c means distance <= r = sqrt(2 - 2c), and on a projection by a standard normal
direction two vectors at distance r differ by a normal number of deviation r. Two uses of that:

* Counting. In a task, vectors are sorted along each of ``COUNTED`` projections and a query-centred window of half-width
  1.5 r gives its collisions. A pair passes if it collides on at least l projections, where l is the largest count that a
  pair at distance r reaches but for once in 1 / ``MISS``. Closer pairs reach it more often. Passing pairs get their cosine.
* Dealing. Tasks get slices of sorted projections: a cell is the place of a vector along k projections cut into slices of 8 r,
  with a start of its own. A pair at distance r shares one slice with probability p, a cell with p^k, and one of T cells but
  for (1 - p^k)^T; T is chosen so that this is at most ``MISS`` too. k grows with the rows of a label and with how much its
  rows spread along projections, which is measured; a small label is one cell.

Cells of more than ``ROWS`` rows are split into blocks that meet two by two, so no task holds more than twice that, and a pair
counts only in the first cell that it shares. What leaves a task is one row for each linked vector: its links and the
smallest member of its group there, never pairs. Equal vectors are one node with a weight.

Cases. Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing and stand
alone; so do vectors of different lengths towards each other. A null id takes part: its row counts as a vector, its
component's id is the smallest id there is, or null. Rows that repeat an id are vectors of their own; with equal vectors they
link. ``kept`` is false without an id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import materialise
from duewise.llm.components import components

COSINE = 0.98
#: Share of pairs at the threshold that dealing, and that counting, may lose each.
MISS = 1e-6
COUNTED = 16
HALF_WINDOW, SLICE = 1.5, 8.0
#: Rows of a cell that are met at once; k is chosen for about half as many.
ROWS = 1024
MOST_K = 12
SEED = 20_011


def radius(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def least_count(projections: int = COUNTED, half_window: float = HALF_WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - miss."""
    p = math.erf(half_window / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def same_slice(width: float = SLICE) -> float:
    """Probability that numbers a normal deviation apart fall into one slice of ``width`` deviations with a random start."""
    return math.erf(width / math.sqrt(2)) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


def tables(k: int, miss: float = MISS) -> int:
    return 1 if k == 0 else math.ceil(math.log(miss) / math.log(1 - same_slice() ** k))


@lru_cache(maxsize=8)
def directions(width: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64([SEED, seed, width]))
    return draw.standard_normal((count, width)).T, draw.random(count)


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def slices(x: np.ndarray, count: int, reach: float) -> np.ndarray:
    """The slice of every vector along ``count`` projections."""
    by, starts = directions(x.shape[1], count, 1)
    return np.floor(x @ by / (SLICE * reach) + starts).astype(np.int64)


def _spread(reach: float):
    def run(frames):
        for f in frames:
            for width, own in f.groupby(f["embedding"].map(len)):
                s = slices(unit(own["embedding"]), MOST_K, reach)
                yield pd.DataFrame({"label": np.repeat(own["label"].to_numpy(), MOST_K), "width": width, "at": np.tile(np.arange(MOST_K), len(own)), "slice": s.ravel()})

    return run


def _cells(reach: float):
    most = MOST_K * tables(MOST_K)

    def run(frames):
        for f in frames:
            cells = [None] * len(f)
            for (width, k), own in f.groupby(["width", "k"]):
                s = slices(unit(own["embedding"]), most, reach).astype(np.uint64)
                out = np.zeros((len(own), tables(int(k))), np.uint64)
                for t in range(out.shape[1]):
                    for j in range(int(k)):
                        out[:, t] = (out[:, t] ^ s[:, t * MOST_K + j]) * np.uint64(0x9E3779B97F4A7C15)
                        out[:, t] ^= out[:, t] >> np.uint64(29)
                out = out.view(np.int64)
                for place, row in zip(f.index.get_indexer(own.index), out, strict=True):
                    cells[place] = row
            yield f.drop(columns=["k"]).assign(cells=cells)

    return run


def window_counts(asked: np.ndarray, pool: np.ndarray, half: float) -> np.ndarray:
    """Collisions of each asked vector (rows) with each of the pool: projections on which it lies in the window around the former."""
    kind = np.uint16 if len(pool) < 1 << 16 else np.uint64  # places below lo wrap around and are not under hi - lo
    counts = np.zeros((len(asked), len(pool)), np.uint8)
    for a, b in zip(asked.T, pool.T, strict=True):
        order = np.argsort(b, kind="stable")
        lo, hi = (np.searchsorted(b[order], a + way, side) for way, side in ((-half, "left"), (half, "right")))
        place = np.empty(len(pool), kind)
        place[order] = np.arange(len(pool), dtype=kind)
        counts += (place - lo.astype(kind)[:, None]) < (hi - lo).astype(kind)[:, None]
    return counts


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over pairs a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(cosine: float):
    reach, least = radius(cosine), least_count()

    def run(key, rows):
        _, _, table, _, one, other = key
        rows = rows.sort_values("node")
        x, nodes, weight, block = unit(rows["embedding"]), rows["node"].to_numpy(), rows["weight"].to_numpy(), rows["block"].to_numpy()
        raw = np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])
        cells = np.stack(rows["cells"].to_numpy())
        asked, pool = np.flatnonzero(block == one), np.flatnonzero(block == other)
        by, _ = directions(x.shape[1], COUNTED, 2)
        along = x @ by
        a, b = np.nonzero(window_counts(along[asked], along[pool], HALF_WINDOW * reach) >= least)
        a, b = asked[a], pool[b]
        new = a < b if one == other else np.ones(len(a), bool)
        a, b = a[new], b[new]
        if table:
            new = ~(cells[a, :table] == cells[b, :table]).any(axis=1)
            a, b = a[new], b[new]
        length = np.sqrt((raw * raw).sum(axis=1))
        near = np.concatenate([np.einsum("ij,ij->i", raw[a[i : i + 65536]], raw[b[i : i + 65536]]) / (length[a[i : i + 65536]] * length[b[i : i + 65536]]) >= cosine for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[near], b[near]
        links = np.bincount(a, weight[b], len(nodes)) + np.bincount(b, weight[a], len(nodes))
        group, shown = nodes[_groups(len(nodes), a, b)], links > 0
        return pd.DataFrame({"node": nodes[shown], "root": group[shown], "links": links[shown].astype(np.int64)})

    return run


def nodes_of(vectors: DataFrame, key: str, label: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the hashes of their vector where they take part, and one node with a weight for each different vector of a label."""
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    length = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    part = F.coalesce(F.col(label).isNotNull() & sound & (length > 0), F.lit(False))
    rows = vectors.select(
        F.col(key).alias("vec_id"), F.when(part, F.col(label)).alias("label"), F.when(part, F.xxhash64(vector)).alias("h1"),
        F.when(part, F.xxhash64(F.lit(SEED), vector, F.size(vector))).alias("h2"), F.when(part, x).alias("embedding"),
    )
    same = rows.where("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("vec_id"))
    nodes = same.withColumns({"node": F.monotonically_increasing_id(), "width": F.size("embedding").cast("long")})
    return rows.drop("embedding"), materialise(nodes, "vector-nodes")


def partial_links(nodes: DataFrame, cosine: float = COSINE, rows_at_once: int = ROWS) -> DataFrame:
    """node, root, links: what each tile of a cell found; a node has a row for every tile in which it has links."""
    reach, kind = radius(cosine), nodes.schema["label"].dataType.simpleString()
    spread = nodes.select("label", "embedding").mapInPandas(_spread(reach), f"label {kind}, width long, at long, slice long")
    by_slice = spread.groupBy("label", "width", "at", "slice").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_label = by_slice.groupBy("label", "width").agg((F.sum("n") / MOST_K).alias("rows"), (F.sum(F.col("n") * F.col("n")) / MOST_K).alias("together"))
    share = F.col("together") / (F.col("rows") * F.col("rows"))
    k = F.ceil(F.log(2 * F.col("rows") / rows_at_once) / -F.log(F.least(share, F.lit(0.999))))
    by_label = materialise(by_label.select("label", "width", F.greatest(F.lit(0), F.least(F.lit(MOST_K), k)).cast("long").alias("k")), "vector-labels")

    placed = nodes.join(by_label, ["label", "width"]).select("label", "width", "node", "weight", "embedding", "k")
    element = nodes.schema["embedding"].dataType.simpleString()
    placed = placed.mapInPandas(_cells(reach), f"label {kind}, width long, node long, weight long, embedding {element}, cells array<long>")
    placed = materialise(placed, "vector-cells")
    cell = ["label", "width", "table", "cell"]
    one = F.posexplode("cells").alias("table", "cell")
    sizes = placed.select("label", "width", one).groupBy(*cell).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    held = placed.select("*", one).join(sizes, cell)
    blocks = F.ceil(F.col("rows") / rows_at_once).cast("long")
    held = held.withColumns({"_blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks)})
    held = held.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    held = held.select(*cell, F.least("block", "_with").alias("one"), F.greatest("block", "_with").alias("other"), "node", "weight", "block", "embedding", "cells")
    return held.groupBy(*cell, "one", "other").applyInPandas(_links(cosine), "node long, root long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", label: str = "label", vector: str = "embedding", rows_at_once: int = ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows, nodes = nodes_of(vectors, key, label, vector)
    found = materialise(partial_links(nodes, cosine, rows_at_once), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = nodes.select("node", "label", "h1", "h2", "weight", "vec_id").join(links, "node", "left").join(reached.withColumnRenamed("label", "group"), "node", "left")
    own = materialise(own.withColumn("group", F.coalesce("group", "node")).where("weight > 1 OR links IS NOT NULL"), "vector-groups")
    least = own.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    own = own.join(least, "group").select("label", "h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("_grouped"))
    out = rows.join(own, ["label", "h1", "h2"], "left")
    component = F.when(F.col("_grouped"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), u AS (SELECT *, sqrt(list_inner_product(x, x)) AS size FROM v WHERE len(x) > 0 AND list_inner_product(x, x) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
