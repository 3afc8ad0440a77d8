"""Hybrid retrieval: cosine, BM25 and amount closeness over a relaxed candidate pool, fused by reciprocal rank.

A candidate among the k best fused over L lists has some rank of at most N = L * (K + k) - K: the k best of any single
list already score 1 / (K + k), and a candidate whose ranks all exceed N scores less. So the N first of each list hold
every winner, and a task lets no more than these leave.

A task meets a block of queries with a shard of their pool, up to ``SHARD`` cases. Cosines and BM25 of many queries are matrix
products; cosines are in single precision, and what lies within its error of a bound is scored again in double. Amounts are
sorted, so ranks by closeness are found by bisection. No list is sorted as a whole: its first N are taken, a sorted sample of the
cases and the amounts say how far behind a candidate is at least in its other lists, and only for candidates that can still win
are the better cases counted. Ranks inside a pool of one shard are exact at once; otherwise they are counted over the shards in
a second pass. BM25 alone needs no counts: it reads an inverted index whose blocks carry the largest part of each term, and only
those blocks that can still reach the query's first N. Closeness alone needs no tasks over the pool: a query reads the buckets
of amounts around its own.

Terms are compared by 64-bit hashes. Scores tie when equal to nine digits, or above 70,000; ties go to the
smaller id.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.text import tokens
from duewise.operators.prefix import before, chunked_prefix
from duewise.session import give_back, materialise

LISTS = ("vector", "bm25", "amount")
#: Queries of a block that meets ``CASE_BLOCK`` cases of several shards; cases, tokens and numbers of vectors in a shard at most.
QUERY_BLOCK, CASE_BLOCK = 512, 65_536
SHARD, TOKENS_A_SHARD, NUMBERS_A_SHARD = 1 << 17, 8_000_000, 65_536 * 384
#: Queries of a block at most where a pool is one small shard: its cases are copied for every block, so a block takes as many
#: queries as make the work of ``QUERY_BLOCK`` queries and a full shard, times ``BLOCKS_IN_ONE``.
MOST_QUERIES, BLOCKS_IN_ONE = 16_384, 8
CASES_A_BLOCK = 256
SCORES_AT_ONCE = 4_000_000  # of a list: a product with fewer queries takes longer for each
CASES_AT_ONCE = 8192  # cases in a product of cosines
STEPS, MARGIN = 64_000, 500  # of scores in two bytes, and what lies below them
NEAR_AT_ONCE = 1_000_000  # cases near a bound that are scored in double at once
SAMPLE = 8192  # cases whose scores are sorted for every query
TOKENS_AT_ONCE = 250_000  # an index is built from so many tokens at a time
#: Scores tie at nine digits; a key holds a rounded score above the place of the case.
ROUNDED, PLACE_BITS = 1e9, 17
_UNKNOWN, _OUT = (1 << 46) - 1, (1 << 63) - 1
#: Scores that differ by more do not tie.
_TIE = 2 / ROUNDED
LEVELS = 6


def _key(level: int, *parts: str) -> Column:
    return F.concat_ws("|", F.lit(str(level)), *[F.col(p) for p in parts])


def level_keys(disputed: Column) -> Column:
    """Pool keys a row belongs to, most specific first; disputed rows also have the dispute levels."""
    plain = [_key(4, "segment", "industry"), _key(5, "segment"), _key(6)]
    first = [_key(1, "segment", "industry"), _key(2, "segment"), _key(3)]
    return F.when(disputed, F.array(*first, *plain)).otherwise(F.array(*plain))


def pool_sizes(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode(level_keys(F.col("is_disputed"))).alias("pool")).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


def choose_pools(queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """First relaxation level with enough candidates, else the last. Decided once per kind of query, not per query."""
    kind = ["segment", "industry", "is_disputed", "own_disputed"]
    levels = queries.select(*kind).distinct().select("*", F.explode(level_keys(F.col("is_disputed"))).alias("pool"))
    level = F.substring("pool", 1, 1).cast("int")
    own = F.when(F.col("own_disputed").isNull(), 0).when((level <= 3) & ~F.col("own_disputed"), 0).otherwise(1)
    counted = levels.join(sizes, "pool", "left").select(*kind, "pool", level.alias("level"), (F.coalesce("n", F.lit(0)) - own).alias("n"))
    enough = F.when(F.col("n") >= P.MIN_CANDIDATES, F.col("level")).otherwise(F.lit(LEVELS))
    chosen = counted.groupBy(*kind).agg(F.min_by(F.struct("pool", "n"), F.struct(enough, -F.col("level"))).alias("c"))
    pick = chosen.select(
        *[F.col(c).alias(f"_{c}") for c in kind], F.col("c.pool").alias("pool"), F.col("c.n").alias("n_candidates")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kind])
    return queries.join(pick, same).drop(*[f"_{c}" for c in kind])


def _idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def bm25_mean_idf(cases: DataFrame) -> DataFrame:
    """Per pool the mean idf of all its terms. ``cases``: pool, doc_id, tokens."""
    n = cases.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    words = cases.select("pool", F.explode(F.array_distinct("tokens")).alias("term"))
    df = words.groupBy("pool", "term").agg(F.count(F.lit(1)).alias("df")).groupBy("pool", "df").agg(F.count(F.lit(1)).alias("terms"))
    idf = _idf(F.col("n"), F.col("df"))
    return df.join(n, "pool").groupBy("pool").agg((F.sum(idf * F.col("terms")) / F.sum("terms")).alias("mean_idf"))


def bm25_query_weights(asked: DataFrame, cases: DataFrame, exclude_self: bool) -> DataFrame:
    """Per query: its terms, their weight (count times idf in the pool) and the pool's mean length.

    ``asked``: query_id, pool, q_tokens. ``cases``: pool, doc_id, tokens. With ``exclude_self`` the query's own case is
    taken out of the pool statistics.
    """
    stats = cases.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("length"))
    words = cases.select("pool", F.explode(F.array_distinct("tokens")).alias("term"))
    df = words.groupBy("pool", "term").agg(F.count(F.lit(1)).alias("df")).join(stats, "pool")
    terms = asked.select("query_id", "pool", F.explode("q_tokens").alias("term")).groupBy("query_id", "pool", "term").agg(
        F.count(F.lit(1)).alias("qtf")
    )
    if not exclude_self:
        mean = df.groupBy("pool").agg(F.avg(_idf(F.col("n"), F.col("df"))).alias("mean_idf"))
        rows = terms.join(df, ["pool", "term"]).join(mean, "pool")
        rows = rows.select("query_id", "term", "qtf", _idf(F.col("n"), F.col("df")).alias("idf"), "mean_idf",
                           (F.col("length") / F.col("n")).alias("avgdl"))
    else:
        less = F.col("n") - 1
        # A word of every case, the own one included, counts n - 1 times without it; n would leave the logarithm undefined.
        capped = _idf(less, F.least(F.col("df"), less))
        whole = df.groupBy("pool").agg(F.sum(capped).alias("idf_sum"), F.count(F.lit(1)).alias("n_terms"))
        mine = asked.join(cases.withColumnRenamed("doc_id", "query_id"), ["query_id", "pool"])
        own = mine.select("query_id", "pool", F.explode(F.array_distinct("tokens")).alias("term")).withColumn("own", F.lit(1))
        shift = F.when(F.col("df") > 1, _idf(less, F.col("df") - 1)).otherwise(0.0) - capped
        moved = own.join(df, ["pool", "term"]).groupBy("query_id").agg(
            F.sum(shift).alias("shift"), F.count_if(F.col("df") == 1).alias("gone")
        )
        lengths = mine.select("query_id", F.size("tokens").alias("own_length"))
        rows = (
            terms.join(df, ["pool", "term"]).join(own, ["query_id", "pool", "term"], "left")
            .join(whole, "pool").join(moved, "query_id").join(lengths, "query_id")
            .withColumn("left", F.col("df") - F.coalesce("own", F.lit(0))).filter(F.col("left") > 0)
            .select("query_id", "term", "qtf", _idf(less, F.col("left")).alias("idf"),
                    ((F.col("idf_sum") + F.col("shift")) / (F.col("n_terms") - F.col("gone"))).alias("mean_idf"),
                    ((F.col("length") - F.col("own_length")) / less).alias("avgdl"))
        )
    weight = F.col("qtf") * F.when(F.col("idf") < 0, P.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    return rows.groupBy("query_id").agg(
        F.collect_list(F.struct("term", weight.alias("weight"))).alias("w"), F.max("avgdl").alias("avgdl")
    ).select("query_id", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"), "avgdl")


# Inside a task: a block of queries meets a shard of a pool


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m /= np.where(length > 0, length, 1.0)
    return np.nan_to_num(m, copy=False, nan=0.0, posinf=0.0, neginf=0.0)  # a vector without direction scores 0


def _keys(scores: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ascending integers in the order of falling score, rounded so that equal scores tie, then of rising place."""
    codes = np.rint(scores * -ROUNDED)
    codes[np.isnan(codes)] = _UNKNOWN  # an unknown amount is the farthest
    return (np.clip(codes, -_UNKNOWN, _UNKNOWN).astype(np.int64) << PLACE_BITS) | places


class Search(NamedTuple):
    """What a query has read of an index: scores by slot, complete in the blocks that are done, with the keys of their cases."""

    found: np.ndarray
    scores: np.ndarray
    common: np.ndarray
    done: np.ndarray
    keys: np.ndarray
    unread: float


class PostingBlocks:
    """Inverted index of a shard over the terms of a query block, in blocks of cases with the largest part of each term.

    Terms that an eighth of the cases hold are columns of a matrix, the others posting lists. Cases that share their rarest term
    lie together, so that rare terms touch few blocks. A block whose upper bound for a query stays below what the query needs is
    not scored.
    """

    def __init__(self, terms: pd.Series, vocabulary: np.ndarray, together: bool = True):
        self.lengths = terms.map(len).to_numpy()
        n, size = len(terms), max(len(vocabulary), 1)
        case, term, tf = self._counted(terms, vocabulary, size)
        df = np.bincount(term, minlength=size)
        rarest = np.full(n, np.iinfo(np.int64).max)
        shared = df[term] > 1
        np.minimum.at(rarest, case[shared], df[term[shared]] * size + term[shared])
        self.order = np.argsort(rarest, kind="stable") if together else np.arange(n)  # place of the case at each slot
        self.slot = np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        by_term = np.lexsort((self.slot[case], term))
        self.case, self.term, self.tf = self.slot[case][by_term].astype(np.int32), term[by_term], tf[by_term]
        self.starts = np.searchsorted(self.term, np.arange(size + 1))
        self.is_common = df * 8 >= max(n, 1)
        self.common = np.flatnonzero(self.is_common)
        self.n, self.size, self.blocks = n, size, -(-n // CASES_A_BLOCK)
        self.mean = None

    def _counted(self, terms: pd.Series, vocabulary: np.ndarray, size: int) -> list[np.ndarray]:
        """case, term, tf of the terms that are asked for, by case and term; only some cases' tokens are held beside them."""
        piece = np.cumsum(self.lengths) // TOKENS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(terms)]
        found = [[np.zeros(0, np.int32)] for _ in range(3)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop or not len(vocabulary):
                continue
            flat = np.concatenate([np.asarray(t, np.int64) for t in terms.iloc[start:stop]])
            owner = np.repeat(np.arange(start, stop), self.lengths[start:stop])
            at = np.searchsorted(vocabulary, flat)
            hit = vocabulary[np.minimum(at, size - 1)] == flat
            pair, tf = np.unique(owner[hit] * size + at[hit], return_counts=True)
            for column, x in zip(found, (pair // size, pair % size, tf), strict=True):
                column.append(x.astype(np.int32))
        return [np.concatenate(x) for x in found]

    def weigh(self, mean: float) -> None:
        """Parts of every posting for cases of this mean length."""
        if self.mean == mean:
            return
        self.mean = mean
        norm = P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * self.lengths[self.order] / mean)
        self.part = self.tf * (P.BM25_K1 + 1) / (self.tf + norm[self.case])
        self.most = np.zeros((self.size, self.blocks))
        np.maximum.at(self.most, (self.term, self.case // CASES_A_BLOCK), self.part)
        self.columns = np.zeros((len(self.common), self.n))
        for row, t in enumerate(self.common):
            own = slice(self.starts[t], self.starts[t + 1])
            self.columns[row, self.case[own]] = self.part[own]

    def query(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the rare terms at every slot, weights of the common ones, and the upper bound of each block."""
        common = np.zeros(self.size)
        common[terms] = weights
        scores, rare = np.zeros(self.n), ~self.is_common[terms]
        for t, w in zip(terms[rare], weights[rare], strict=True):
            own = slice(self.starts[t], self.starts[t + 1])
            scores[self.case[own]] += w * self.part[own]
        return scores, common[self.common], np.maximum(weights, 0) @ self.most[terms] * (1 + 1e-9) + 1e-8

    def add(self, scores: np.ndarray, common: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Completes the scores of some blocks; gives their slots."""
        slots = (blocks[:, None] * CASES_A_BLOCK + np.arange(CASES_A_BLOCK)).ravel()
        slots = slots[slots < self.n]
        scores[slots] += common @ (self.columns if len(slots) == self.n and (np.diff(blocks) == 1).all() else self.columns[:, slots])
        return slots

    def best(self, terms: np.ndarray, weights: np.ndarray, count: int, out: int) -> Search:
        """The best ``count`` cases, reading blocks in the order of their bounds until none can hold a better one."""
        scores, common, bounds = self.query(terms, weights)
        ahead = np.argsort(-bounds, kind="stable")
        done = np.zeros(self.blocks, bool)
        step, keys, every = max(1, -(-2 * count // CASES_A_BLOCK)), np.zeros(0, np.int64), []
        while True:
            level = -np.inf if len(keys) < count or keys[count - 1] >= _OUT else -(keys[count - 1] >> PLACE_BITS) / ROUNDED - 1e-9
            wanted = ahead[~done[ahead] & (bounds[ahead] >= level)]
            if not len(wanted):
                break
            blocks = np.sort(wanted[:step])
            slots = self.add(scores, common, blocks)
            done[blocks], step = True, step * 4
            places = self.order[slots]
            new = _keys(scores[slots], places)
            new[places == out] = _OUT
            every.append(new)
            keys = np.concatenate([keys, new])
            keys = np.sort(keys[np.argpartition(keys, count)[: count + 1]] if len(keys) > count + 1 else keys)
        found = keys[keys < _OUT][:count] & ((1 << PLACE_BITS) - 1)
        return Search(found, scores, common, done, np.concatenate(every or [keys]), bounds[~done].max(initial=-np.inf))

    def ranked(self, search: Search, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ranks of some cases; a rank is nan where a case of a block that was not read may be better."""
        slots = self.slot[places]
        scores = search.scores[slots]
        unread = ~search.done[slots // CASES_A_BLOCK]
        if unread.any():
            scores[unread] += search.common @ self.columns[:, slots[unread]]
        ranks = np.searchsorted(np.sort(search.keys), _keys(scores, places)) + 1.0
        return scores, np.where(scores <= search.unread, np.nan, ranks)


def _index(q: pd.DataFrame, c: pd.DataFrame, together: bool = True) -> tuple[PostingBlocks, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The shard's index, and each query's term numbers, weights and mean length; where the queries have none yet, the shard is their pool."""
    if "q_tokens" not in q or q["q_tokens"].isna().any():
        words = [np.asarray(t if t is not None else [], np.int64) for t in q["terms"]]
        vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.int64)
        weights = [np.asarray(w if w is not None else [], np.float64) for w in q["weights"]]
        return PostingBlocks(c["tokens"], vocabulary, together), [np.searchsorted(vocabulary, w) for w in words], weights, _means(q)
    tokens = [np.asarray(t, np.int64) for t in q["q_tokens"]]
    vocabulary, at = np.unique(np.concatenate(tokens), return_inverse=True)
    index, size = PostingBlocks(c["tokens"], vocabulary, together), max(len(vocabulary), 1)
    ids, owner = np.unique(q["query_id"], return_inverse=True)  # words of an id that comes again are counted together
    pair, count = np.unique(np.repeat(owner, [len(t) for t in tokens]) * size + at, return_counts=True)
    term, n, df = pair % size, len(c), np.diff(index.starts)
    idf = np.log(n - df + 0.5) - np.log(df + 0.5)
    weight = count * np.where(idf < 0, P.BM25_EPSILON * q["mean_idf"].iat[0], idf)[term]
    held = df[term] > 0
    cuts = np.searchsorted((pair // size)[held], np.arange(1, len(ids)))
    words, weights = np.split(term[held], cuts), np.split(weight[held], cuts)
    return index, [words[i] for i in owner], [weights[i] for i in owner], np.full(len(q), index.lengths.sum() / n or 1.0)


def _means(q: pd.DataFrame) -> np.ndarray:
    return q["avgdl"].fillna(1.0).to_numpy()


def _own_place(q: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    """Place of the case that a query may not find, -1 if there is none."""
    if q["exclude_id"].isna().any() or not len(ids):
        return np.full(len(q), -1)
    at = np.minimum(np.searchsorted(ids, q["exclude_id"].to_numpy()), len(ids) - 1)
    return np.where(ids[at] == q["exclude_id"].to_numpy(), at, -1)


def _batches(means: np.ndarray, size: int) -> list[np.ndarray]:
    """Queries that are scored at once, of one mean length: parts of postings depend on it."""
    order = np.argsort(means, kind="stable")
    cuts, out = (np.flatnonzero(np.diff(means[order])) + 1).tolist(), []
    for start, stop in zip([0, *cuts], [*cuts, len(means)], strict=True):
        out += [order[at : min(at + size, stop)] for at in range(start, stop, size)]
    return out


def _places_in_group(group: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on within each run of equal numbers."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def _first(at: np.ndarray, places: np.ndarray, keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` least keys of each query: its number, place and rank, and where they were."""
    order = np.lexsort((keys, at))
    rank = _places_in_group(at[order])
    order, rank = order[rank < count], rank[rank < count]
    return at[order], places[order], rank + 1.0, order


class Mask:
    """A mask over cases; where it is true at few places, bytes or words of it are searched."""

    def __init__(self, n: int):
        self.buffer = bytearray(-(-n // 8) * 8)
        self.values, self.words = np.frombuffer(self.buffer, bool)[:n], np.frombuffer(self.buffer, np.uint64)

    def spots(self) -> np.ndarray:
        count = np.count_nonzero(self.values)
        if count * 50 > len(self.values):
            return np.flatnonzero(self.values)
        if count > 50:
            found = (np.flatnonzero(self.words != 0)[:, None] * 8 + np.arange(8)).ravel()
            return found[np.frombuffer(self.buffer, bool)[found]]
        out, at = np.empty(count, np.int64), -1
        for i in range(count):
            out[i] = at = self.buffer.find(1, at + 1)
        return out


class Groups:
    """Candidates of a batch by query and rounded score. A group's better cases are counted, its near ones compared by key."""

    def __init__(self, at: np.ndarray, keys: np.ndarray):
        self.order = np.lexsort((keys, at))
        self.keys, owner = keys[self.order], at[self.order]
        codes = self.keys >> PLACE_BITS
        self.starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])]) if len(at) else np.zeros(0, np.int64)
        self.at, self.codes = owner[self.starts], codes[self.starts]
        self.stops, self.out = np.r_[self.starts[1:], len(at)], np.zeros(len(at), np.int64)

    def compare(self, groups: range, far: np.ndarray, near: np.ndarray, stops: np.ndarray) -> None:
        """``far`` cases come before all of a group; ``near``: keys of its other cases, which end at ``stops``."""
        start = 0
        for g, ahead, stop in zip(groups, far, stops, strict=True):
            own, keys, start = slice(self.starts[g], self.stops[g]), near[start:stop], stop
            mine = self.keys[own]
            self.out[self.order[own]] = ahead + (np.count_nonzero(keys < mine[0]) if len(mine) == 1 else np.searchsorted(np.sort(keys), mine))


class Scores:
    """Scores of a batch of queries for every case of a shard.

    Steps of two bytes stand for all of them: ``score * scale + shift``, off by no more than ``error`` of a score. They find the cases
    whose scores are needed, which ``exact`` gives.
    """

    def __init__(self, steps: np.ndarray, scale: np.ndarray, shift: np.ndarray, own: np.ndarray, error: float):
        self.steps, self.scale, self.shift, self.own, self.error = steps, scale, shift, own, error + _TIE
        self.masks = Mask(steps.shape[1]), Mask(steps.shape[1])
        mine = np.flatnonzero(own >= 0)
        steps[mine, own[mine]] = 0
        self.sample = np.sort(steps[:, :: max(1, steps.shape[1] // SAMPLE)], axis=1, kind="stable")

    def exact(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def exact_of(self, at: int, places: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def step(self, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(scores * self.scale[at] + self.shift[at]), 0, 65_535).astype(np.uint16)

    def _from(self, at: int, step: int) -> np.ndarray:
        np.greater_equal(self.steps[at], step, out=self.masks[0].values)
        return self.masks[0].spots()

    def first(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and rank of the best ``count`` cases of each."""
        size, left, out = self.sample.shape[1], np.arange(len(self.steps)), []
        wanted = np.full(len(left), 2 * -(-count * size // self.steps.shape[1]))  # about twice as many as needed reach this step
        steps = np.where(wanted < size, self.sample[left, np.maximum(size - wanted, 0)], 0)
        while len(left):
            held = [self._from(i, step) for i, step in zip(left, steps, strict=True)]
            scores = np.concatenate([self.exact_of(i, x) for i, x in zip(left, held, strict=True)])
            at, places = np.repeat(np.arange(len(left)), [len(x) for x in held]), np.concatenate(held)
            others = np.flatnonzero(places != self.own[left][at])
            at, places, scores = at[others], places[others], scores[others]
            at, places, rank, chosen = _first(at, places, _keys(scores, places), count)
            last, least = rank == count, np.zeros(len(left), np.int64)
            full = at[last]
            least[full] = self.step(left[full], scores[chosen[last]] - self.error)  # below are only worse ones
            done = (steps == 0) | (steps <= least)
            own = done[at]
            out.append((left[at[own]], places[own], rank[own]))
            short = np.setdiff1d(np.arange(len(left)), full)
            wanted[short] *= 4
            least[short] = np.where(wanted[short] < size, self.sample[left[short], np.maximum(size - wanted[short], 0)], 0)
            left, steps, wanted = left[~done], least[~done], wanted[~done]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def ahead_at_least(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A number of cases that surely come before each of some cases. ``at`` is in order."""
        beyond = np.ceil(2 * self.error * self.scale[at]) + 1
        steps, cuts = np.minimum(self.steps[at, places] + beyond, 65_535).astype(np.uint16), np.searchsorted(at, np.arange(len(self.steps) + 1))
        found = [np.searchsorted(x, steps[start:stop], side="right") for x, start, stop in zip(self.sample, cuts[:-1], cuts[1:], strict=True) if stop > start]
        return self.sample.shape[1] - np.concatenate(found)

    def ahead(self, at: np.ndarray, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many cases come before each of some cases, whose scores are exact."""
        groups = Groups(at, _keys(scores, places))
        score = groups.codes / -ROUNDED
        high = np.where(groups.codes > -_UNKNOWN, self.step(groups.at, score + self.error), 65_535).astype(np.uint16)
        low = self.step(groups.at, score - self.error)
        (above, mask), begun, far, near, held = self.masks, 0, [], [], 0
        for g, i in enumerate(groups.at.tolist()):
            row = self.steps[i]
            np.greater(row, high[g], out=above.values)
            far.append(np.count_nonzero(above.values))
            if low[g] == high[g]:
                np.equal(row, high[g], out=mask.values)
            else:
                np.greater_equal(row, low[g], out=mask.values)
                np.not_equal(above.values, mask.values, out=mask.values)
            close = mask.spots()
            near.append(close if low[g] else close[close != self.own[i]])
            held += len(near[-1])
            if held > NEAR_AT_ONCE or g + 1 == len(groups.at):
                sizes, close = [len(x) for x in near], np.concatenate(near)
                keys = _keys(self.exact(np.repeat(groups.at[begun : g + 1], sizes), close), close)
                groups.compare(range(begun, g + 1), far, keys, np.cumsum(sizes))
                begun, far, near, held = g + 1, [], [], 0
        return groups.out


class Kinds:
    """Cases that are alike in their length and in all common terms, compared by 64-bit hashes: their scores differ by rare terms only."""

    def __init__(self, index: PostingBlocks):
        self.index, draw = index, np.random.default_rng(0).integers(1, 1 << 63, len(index.is_common) + 1, np.uint64)
        hashed, common = index.lengths.astype(np.uint64) * draw[-1], index.is_common[index.term]
        np.add.at(hashed, index.case[common], index.tf[common].astype(np.uint64) * draw[index.term[common]])
        _, self.example, self.kind = np.unique(hashed, return_index=True, return_inverse=True)
        self.order = np.argsort(self.kind, kind="stable")
        self.placed = (self.kind[self.order] << PLACE_BITS) | self.order
        self.sizes = np.bincount(self.kind, minlength=len(self.example))
        self.starts = np.cumsum(self.sizes) - self.sizes


class Asked(NamedTuple):
    """A query's kinds by falling score with the cases before each, and the cases that hold its rare terms, by place."""

    kinds: np.ndarray
    codes: np.ndarray
    before: np.ndarray
    rare: np.ndarray
    parts: np.ndarray
    keys: np.ndarray
    without: np.ndarray


class Words:
    """BM25 of a batch of queries. Whole kinds of cases are scored, and one by one only the cases that hold a rare term of the query."""

    def __init__(self, kinds: Kinds, words: list[np.ndarray], weights: list[np.ndarray], own: np.ndarray):
        self.all, self.own, index, most = kinds, own, kinds.index, _UNKNOWN / ROUNDED
        common, self.asked, added = np.zeros((len(words), index.size)), [], np.zeros(index.n)
        for row, terms, weight in zip(common, words, weights, strict=True):
            row[terms] = weight
        self.base = common[:, index.common] @ index.columns[:, kinds.example]
        every = np.sort(_keys(self.base, np.arange(len(kinds.sizes))), axis=1)
        for base, ordered, terms, weight in zip(self.base, every, words, weights, strict=True):
            rare, held = ~index.is_common[terms], [np.zeros(0, np.int64)]
            for t, w in zip(terms[rare], weight[rare], strict=True):
                part = slice(index.starts[t], index.starts[t + 1])
                added[index.case[part]] += w * index.part[part]
                held.append(index.case[part])
            places = np.sort(np.concatenate(held))
            places = places[np.r_[True, places[1:] != places[:-1]]] if len(places) else places
            parts, order, plain = added[places], ordered & ((1 << PLACE_BITS) - 1), base[kinds.kind[places]]
            added[places] = 0.0
            before = np.concatenate([[0], np.cumsum(kinds.sizes[order])])
            self.asked.append(Asked(order, ordered >> PLACE_BITS, before, places, parts, np.sort(_keys(plain + parts, places)), np.sort(_keys(plain, places))))

    def first(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and rank of the best ``count`` cases of each."""
        kinds, is_rare, found, count = self.all, np.zeros(self.all.index.n, bool), [], count + 1  # one may be the own case
        for i, q in enumerate(self.asked):
            here = np.bincount(kinds.kind[q.rare], minlength=len(kinds.sizes))
            at = np.searchsorted(np.cumsum((kinds.sizes - here)[q.kinds]), count)
            code = q.codes[at] if at < len(q.codes) else _OUT  # of the last kind that is needed
            some = q.kinds[: np.searchsorted(q.codes, code, side="right")]
            is_rare[q.rare] = True
            _, spots = _ranges(kinds.starts[some], kinds.starts[some] + np.minimum(kinds.sizes[some], count + here[some]))
            places = kinds.order[spots]
            places = places[~is_rare[places]]
            is_rare[q.rare] = False
            scored = self.base[i, kinds.kind[q.rare]] + q.parts
            keys = _keys(scored, q.rare)
            near = keys >> PLACE_BITS <= code
            places, keys = np.concatenate([places, q.rare[near]]), np.concatenate([_keys(self.base[i, kinds.kind[places]], places), keys[near]])
            if self.own[i] >= 0:
                keys, places = keys[places != self.own[i]], places[places != self.own[i]]
            order = np.argsort(keys)[: count - 1]
            found.append((np.full(len(order), i), places[order], np.arange(1.0, len(order) + 1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _by_query(self, at: np.ndarray):
        cuts = np.searchsorted(at, np.arange(len(self.asked) + 1)).tolist()
        return [(i, q, slice(start, stop)) for i, (q, start, stop) in enumerate(zip(self.asked, cuts[:-1], cuts[1:], strict=True)) if stop > start]

    def exact(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """``at`` is in order, here and below."""
        out = self.base[at, self.all.kind[places]]
        for _, q, part in self._by_query(at):
            if len(q.rare):
                spots = np.minimum(np.searchsorted(q.rare, places[part]), len(q.rare) - 1)
                out[part] += np.where(q.rare[spots] == places[part], q.parts[spots], 0.0)
        return out

    def ahead(self, at: np.ndarray, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many cases come before each of some cases of these scores."""
        keys, out = _keys(scores, places), np.zeros(len(at), np.int64)
        for i, q, part in self._by_query(at):
            key, code = keys[part], keys[part] >> PLACE_BITS
            start, stop = np.searchsorted(q.codes, code), np.searchsorted(q.codes, code, side="right")
            owner, spots = _ranges(start, stop)  # kinds that tie
            tied = q.kinds[spots]
            earlier = np.searchsorted(self.all.placed, (tied << PLACE_BITS) | places[part][owner]) - self.all.starts[tied]
            out[part] = q.before[start] + np.bincount(owner, earlier, len(key)).astype(np.int64) + np.searchsorted(q.keys, key) - np.searchsorted(q.without, key)
            if self.own[i] >= 0:
                mine = self.own[i : i + 1]
                out[part] -= _keys(self.exact(np.array([i]), mine), mine) < key
        return out


class Vectors:
    """Stored vectors, what each is multiplied with to have length 1, and the products in single precision."""

    def __init__(self, stored: np.ndarray):
        self.stored, self.scale, longest = stored, np.ones(len(stored)), 1.0
        self.unit = np.empty(stored.shape, np.float32)
        for start in range(0, len(stored), 4096):
            part, rows = slice(start, start + 4096), stored[start : start + 4096].astype(np.float64)
            unit, length = _unit(rows), np.linalg.norm(rows, axis=1)
            usual = np.isfinite(length) & (length > 0)
            self.scale[part][usual] = 1 / length[usual]
            stored[part][~usual], self.unit[part] = unit[~usual], unit
            longest = max(longest, np.linalg.norm(unit, axis=1).max(initial=0.0))
        self.scale_of_steps = STEPS / (2 * longest)
        # Rounding of both factors, of every product and of every sum, twice: the absolute products add up to the lengths' product at most.
        # The step itself is rounded where it is added to half of all steps.
        self.error = (stored.shape[1] + 4) * 2.0**-23 * longest + 2.0**-7 / self.scale_of_steps


class Cosines(Scores):
    """A product in single precision; ``exact`` scores in double from the stored vectors."""

    def __init__(self, asked: np.ndarray, cases: Vectors, own: np.ndarray, steps: np.ndarray):
        self.asked, self.cases = asked, cases
        scale, shift = np.full(len(asked), cases.scale_of_steps), np.full(len(asked), MARGIN + STEPS / 2)
        scaled, some = (asked * cases.scale_of_steps).astype(np.float32), np.empty((len(asked), CASES_AT_ONCE), np.float32)
        for start in range(0, steps.shape[1], CASES_AT_ONCE):
            part = cases.unit[start : start + CASES_AT_ONCE]
            found = np.matmul(scaled, part.T, out=some if len(part) == CASES_AT_ONCE else None)
            np.add(found, np.float32(shift[0]), out=steps[:, start : start + CASES_AT_ONCE], casting="unsafe")
        super().__init__(steps, scale, shift, own, cases.error)

    def exact(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(at)), max(1, SCORES_AT_ONCE // (4 * self.asked.shape[1]))
        for start in range(0, len(at), step):
            part = slice(start, start + step)
            np.einsum("ij,ij->i", self.cases.stored[places[part]].astype(np.float64, copy=False), self.asked[at[part]], out=out[part])
        return out * self.cases.scale[places]

    def exact_of(self, at: int, places: np.ndarray) -> np.ndarray:
        return (self.cases.stored[places].astype(np.float64, copy=False) @ self.asked[at]) * self.cases.scale[places]


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and the range each is of."""
    sizes = np.maximum(stops - starts, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner]


class Closeness:
    """Ranks by distance of sorted log amounts for a batch of queries; what is not finite is farthest from everything."""

    def __init__(self, amounts: np.ndarray):
        self.amounts, known = amounts, np.isfinite(amounts)
        self.unknown, self.order = np.flatnonzero(~known), np.flatnonzero(known)
        self.order = self.order[np.argsort(amounts[self.order], kind="stable")]
        self.sorted = amounts[self.order]

    def ask(self, values: np.ndarray, own: np.ndarray) -> Closeness:
        self.values, self.own = values, own
        return self

    def exact(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return -np.abs(self.amounts[places] - self.values[at])

    def _within(self, at: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the sorted amounts that are no farther than ``away``."""
        return np.searchsorted(self.sorted, self.values[at] - away), np.searchsorted(self.sorted, self.values[at] + away, side="right")

    def first(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, known = len(self.sorted), np.isfinite(self.values)
        lost, few = np.flatnonzero(~known), np.flatnonzero(known) if m <= count + 1 else np.zeros(0, np.int64)
        usual = np.flatnonzero(known) if m > count + 1 else np.zeros(0, np.int64)
        found = [(np.repeat(lost, min(len(self.amounts), count + 1)), np.tile(np.arange(min(len(self.amounts), count + 1)), len(lost)))]
        every = np.concatenate([self.order, self.unknown[: count + 1]]) if len(few) else self.order
        found.append((np.repeat(few, len(every)), np.tile(every, len(few))))
        if len(usual):
            spots = np.searchsorted(self.sorted, self.values[usual])[:, None] + np.arange(-count - 1, count + 1)
            away = np.abs(self.sorted[np.clip(spots, 0, m - 1)] - self.values[usual][:, None])
            away[(spots < 0) | (spots >= m)] = np.inf
            owner, spots = _ranges(*self._within(usual, np.partition(away, count, axis=1)[:, count] + _TIE))
            found.append((usual[owner], self.order[spots]))
        at, places = (np.concatenate(x) for x in zip(*found, strict=True))
        others = places != self.own[at]
        at, places = at[others], places[others]
        return _first(at, places, _keys(self.exact(at, places), places), count)[:3]

    def ahead_at_least(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A number of cases that surely come before each of some cases; one less, as the own one may be among them."""
        away, known = -self.exact(at, places), np.isfinite(self.values[at])
        out, at = np.zeros(len(at), np.int64), at[known]
        start, stop = self._within(at, np.where(np.isfinite(away[known]), away[known], np.inf) - _TIE)
        out[known] = np.maximum(stop - start - 1, 0)
        return out

    def ahead(self, at: np.ndarray, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many cases come before each of some cases of these scores."""
        keys = _keys(scores, places)
        groups = Groups(at, keys)
        away = groups.codes / ROUNDED
        (left, right), (start, stop) = self._within(groups.at, away - _TIE), self._within(groups.at, away + _TIE)
        far, open_ = np.maximum(right - left, 0), right > left
        owner, spots = _ranges(np.r_[start, right], np.r_[np.where(open_, left, stop), np.where(open_, stop, right)])
        order = np.argsort(owner % max(len(away), 1), kind="stable")
        owner, near = owner[order] % max(len(away), 1), self.order[spots[order]]
        sizes = np.bincount(owner, minlength=len(away))
        groups.compare(range(len(away)), far, _keys(self.exact(groups.at[owner], near), near), np.cumsum(sizes))
        out, unknown, lost = groups.out, ~np.isfinite(scores), ~np.isfinite(self.values[at])
        out[unknown] = len(self.sorted) + np.searchsorted(self.unknown, places[unknown])
        out[lost] = places[lost]  # to a query of unknown amount all are equally far
        own = np.flatnonzero(self.own[at] >= 0)
        mine = self.own[at[own]]
        out[own] -= _keys(self.exact(at[own], mine), mine) < keys[own]
        return out


def _fused(ranks: np.ndarray) -> np.ndarray:
    return sum(1.0 / (P.RRF_K + r) for r in ranks)


def _nth(at: np.ndarray, ranks: np.ndarray, k: int, queries: int) -> np.ndarray:
    """What the ``k`` best of a query score at least, by the ranks that are known."""
    low = sum(np.nan_to_num(1.0 / (P.RRF_K + r), nan=0.0) for r in ranks)
    order = np.lexsort((-low, at))
    spots = np.searchsorted(at[order], np.arange(queries)) + k - 1
    enough = np.bincount(at, minlength=queries) >= k
    out = np.zeros(queries)
    out[enough] = low[order[spots[enough]]] - 1e-12
    return out


def _winners(shard: Shard, at: np.ndarray, places: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query by exact ranks and what ties with them. ``ranks``: a row for each list, nan where not known; ``at`` is in order."""
    queries = len(shard.rows)
    # What is not among the first of a list is behind them.
    floors = np.stack([np.where(np.isnan(r), np.bincount(at[~np.isnan(r)], minlength=queries)[at] + 1.0, r) for r in ranks])
    checked = False
    while True:
        alive = _fused(floors) >= _nth(at, ranks, k, queries)[at]
        at, places, ranks, floors = at[alive], places[alive], ranks[:, alive], floors[:, alive]
        unknown = np.isnan(ranks)
        open_ = np.flatnonzero(unknown.any(axis=0))
        if not len(open_):
            return at, places, ranks
        if not checked:
            checked = True
            for name, r, f, some in zip(shard.lists, ranks, floors, map(np.flatnonzero, unknown), strict=True):
                if not len(some):
                    continue
                if name == "bm25":  # kinds give all ranks at once
                    r[some] = f[some] = shard.scores[name].ahead(at[some], shard.scores[name].exact(at[some], places[some]), places[some]) + 1.0
                else:
                    f[some] = np.maximum(f[some], shard.scores[name].ahead_at_least(at[some], places[some]) + 1)
            continue
        order = open_[np.lexsort((-_fused(floors[:, open_]), at[open_]))]
        picked = order[_places_in_group(at[order]) < k]
        # Of each the list in which it may be farthest ahead; what it loses there may settle it.
        which = np.argmin(np.where(unknown, floors, np.inf)[:, picked], axis=0)
        for n, name in enumerate(shard.lists):
            some = picked[which == n]
            if len(some):
                scores = shard.scores[name]
                floors[n, some] = ranks[n, some] = scores.ahead(at[some], scores.exact(at[some], places[some]), places[some]) + 1.0


class Shard:
    """A shard's cases, ready to be scored in some lists for batches of queries."""

    def __init__(self, lists: tuple[str, ...], q: pd.DataFrame, c: pd.DataFrame):
        self.lists, self.own, size = lists, _own_place(q, c["doc_id"].to_numpy()), min(len(q), max(1, SCORES_AT_ONCE // len(c)))
        if "vector" in lists:
            self.asked, self.vectors = _unit(np.stack(q["q_vec"].to_numpy())), Vectors(np.stack(c["vec"].to_numpy()))
            self.cosines = np.empty((size, len(c)), np.uint16)
        if "bm25" in lists:
            self.index, self.words, self.weights, self.means = _index(q, c, together=False)
            self.kinds = Kinds(self.index)
        if "amount" in lists:
            self.closeness, self.values = Closeness(c["log_amount"].to_numpy(np.float64)), q["q_log_amount"].to_numpy(np.float64)
        self.batches = _batches(self.means if "bm25" in lists else np.ones(len(q)), size)

    def score(self, rows: np.ndarray) -> None:
        """Makes ready for some queries, which are of one mean length; scores of a batch take the place of the last one's."""
        self.rows, self.scores, own = rows, {}, self.own[rows]
        if "vector" in self.lists:
            self.scores["vector"] = Cosines(self.asked[rows], self.vectors, own, self.cosines[: len(rows)])
        if "bm25" in self.lists:
            self.index.weigh(self.means[rows[0]])
            self.scores["bm25"] = Words(self.kinds, [self.words[i] for i in rows], [self.weights[i] for i in rows], own)
        if "amount" in self.lists:
            self.scores["amount"] = self.closeness.ask(self.values[rows], own)


def _best_words(q: pd.DataFrame, c: pd.DataFrame, bound: int) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """The first of each query by BM25 alone, whose ranks are their places in the list."""
    index, words, weights, means = _index(q, c)
    own, out = _own_place(q, c["doc_id"].to_numpy()), []
    for i in np.argsort(means, kind="stable"):
        index.weigh(means[i])
        search = index.best(words[i], weights[i], bound, own[i])
        score, rank = index.ranked(search, search.found)
        out.append((np.full(len(rank), i), search.found, [score], [rank]))
    return out


def _best_of_shard(lists: tuple[str, ...], k: int):
    bound = len(lists) * (P.RRF_K + k) - P.RRF_K
    names = ["query_id", "doc_id", "whole", *[f"s_{name}" for name in lists], *[f"r_{name}" for name in lists]]

    def found(q: pd.DataFrame, c: pd.DataFrame, whole_pool: bool):
        if lists == ("bm25",):
            yield from _best_words(q, c, bound)
            return
        shard, n = Shard(lists, q, c), len(c)
        for rows in shard.batches:
            shard.score(rows)
            tops = [shard.scores[name].first(bound) for name in lists]
            near, spots = np.unique(np.concatenate([at * n + places for at, places, _ in tops]), return_inverse=True)
            at, places, ranks = near // n, near % n, np.full((len(lists), len(near)), np.nan)
            cuts = np.cumsum([len(rank) for _, _, rank in tops])[:-1]
            for r, spot, (_, _, rank) in zip(ranks, np.split(spots, cuts), tops, strict=True):
                r[spot] = rank
            if whole_pool:
                at, places, ranks = _winners(shard, at, places, ranks, k)
            yield rows[at], places, [shard.scores[name].exact(at, places) for name in lists], ranks

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=names)
        c = c.sort_values("doc_id", ignore_index=True)
        whole, asked, ids = q["n_blocks"].iat[0] == 1, q["query_id"].to_numpy(), c["doc_id"].to_numpy()
        rows = [(asked[i], ids[near], np.full(len(near), whole), *values, *ranks) for i, near, values, ranks in found(q, c, whole)]
        out = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*rows, strict=True)), strict=True)))
        for name in lists:
            out[f"s_{name}"] = np.nan_to_num(np.round(out[f"s_{name}"], 9), nan=-1e300)
        give_back()
        return out

    return run


def _better_in_shard(lists: tuple[str, ...]):
    """How many cases of a shard come before each candidate whose rank is not known yet; null where it is known."""
    names = ["query_id", "doc_id", *[f"b_{name}" for name in lists]]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=names)
        c = c.sort_values("doc_id", ignore_index=True)
        ids, found = c["doc_id"].to_numpy(), []
        shard = Shard(lists, q, c)
        for rows in shard.batches:
            shard.score(rows)
            own = [list(q["candidates"].iat[i]) for i in rows]
            at, own = np.repeat(np.arange(len(rows)), [len(x) for x in own]), [x for some in own for x in some]
            docs = np.array([x["doc_id"] for x in own])
            out, spots = {"query_id": q["query_id"].to_numpy()[rows[at]], "doc_id": docs}, np.searchsorted(ids, docs)
            for name in lists:
                out[f"b_{name}"] = np.full(len(docs), np.nan)
                wanted = np.flatnonzero([x[f"r_{name}"] is None or x[f"r_{name}"] != x[f"r_{name}"] for x in own])
                if len(wanted):
                    level = np.array([own[i][f"s_{name}"] for i in wanted], np.float64)
                    level = np.where(level <= -1e299, np.nan, level)
                    out[f"b_{name}"][wanted] = shard.scores[name].ahead(at[wanted], level, spots[wanted])
            found.append(pd.DataFrame(out))
        give_back()
        return pd.concat(found, ignore_index=True)[names]

    return run


def _amount_values(cases: DataFrame, held: int) -> DataFrame:
    """pool, log_amount, docs: every different amount with its first ``held`` cases."""
    place = F.row_number().over(Window.partitionBy("pool", "log_amount").orderBy("doc_id"))
    listed = cases.select("pool", "log_amount", "doc_id").withColumn("_place", place).where(F.col("_place") <= held)
    return materialise(listed.groupBy("pool", "log_amount").agg(F.collect_list("doc_id").alias("docs")), "amounts")


def amounts_around(asked: DataFrame, values: DataFrame, held: int) -> DataFrame:
    """query_id, exclude_id, docs, s_amount: the amounts in a query's own bucket and the ones beside it, whatever the size of its pool."""
    amount, query = F.col("log_amount"), ["query_id", "pool", "q_log_amount", "exclude_id"]
    points = values.where(amount.isNotNull()).select("pool", "log_amount", F.lit(1).alias("is_value"))
    points = points.unionByName(asked.where("q_log_amount IS NOT NULL").select("pool", F.col("q_log_amount").alias("log_amount"), F.lit(0).alias("is_value")))
    points = points.groupBy("pool", "log_amount").agg(F.max("is_value").alias("is_value")).withColumn("_chunk", F.floor(amount * 64))
    placed = chunked_prefix(points, ["pool"], "log_amount", "_chunk", ["is_value"]).select("pool", "log_amount", F.col(before("is_value")).alias("at"))
    width = 2 * held
    bucket = F.floor(F.col("at") / width)
    known = values.join(placed, ["pool", "log_amount"]).select("pool", "log_amount", "docs", bucket.alias("bucket"))
    near = asked.select(*query).join(placed.withColumnRenamed("log_amount", "q_log_amount"), ["pool", "q_log_amount"]).select(
        *query, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")
    )
    away = -F.round(F.abs(F.col("log_amount") - F.col("q_log_amount")), 9)
    return near.join(known, ["pool", "bucket"]).select(*query, "docs", away.alias("s_amount"))


def nearest_amounts(asked: DataFrame, cases: DataFrame, count: int) -> DataFrame:
    """query_id, doc_id, s_amount, r_amount: the ``count`` cases of the pool with the closest log amount.

    ``asked``: query_id, pool, q_log_amount, exclude_id; ``cases``: pool, doc_id, log_amount. A pool's different amounts are numbered
    in order and cut into buckets; a query reads its own bucket and the ones beside it, and of every amount the first ``count``
    cases, so what it reads does not depend on the pool. A case of unknown amount is farther than any other; to a query of
    unknown amount all are equally far. Exact unless more than ``count`` different amounts lie within a billionth of each other.
    """
    held = count + 1  # one of them may be the own case
    values = _amount_values(cases, held)
    query = ["query_id", "pool", "q_log_amount", "exclude_id"]
    read = amounts_around(asked, values, held)
    close = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("s_amount")))
    read = read.withColumn("_close", close).where(F.col("_close") <= held).drop("_close")
    farthest = F.lit(-1e300)
    unknown = asked.where("q_log_amount IS NOT NULL").select(*query).join(values.where("log_amount IS NULL").select("pool", "docs"), "pool")
    first = F.row_number().over(Window.partitionBy("pool").orderBy("doc_id"))
    firsts = cases.select("pool", "doc_id").withColumn("_place", first).where(F.col("_place") <= held).groupBy("pool").agg(F.collect_list("doc_id").alias("docs"))
    lost = asked.where("q_log_amount IS NULL").select(*query).join(firsts, "pool")
    rows = read.unionByName(unknown.withColumn("s_amount", farthest)).unionByName(lost.withColumn("s_amount", farthest))
    rows = rows.select("query_id", "exclude_id", "s_amount", F.explode("docs").alias("doc_id")).where(~F.col("doc_id").eqNullSafe(F.col("exclude_id")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s_amount"), "doc_id"))
    return rows.withColumn("r_amount", best).where(F.col("r_amount") <= count).select("query_id", "doc_id", "s_amount", F.col("r_amount").cast("double").alias("r_amount"))


def block_queries(n: Column, n_blocks: Column, query_block: int, case_block: int) -> Column:
    """Queries of a block in a pool of ``n`` cases. Candidates of several shards all leave the task, so there a block stays short."""
    alike = F.floor(F.lit(query_block * BLOCKS_IN_ONE).cast("double") * case_block / F.greatest(n, F.lit(1)))
    wide = F.least(F.greatest(alike, F.lit(query_block)), F.lit(max(MOST_QUERIES, query_block)))
    return F.when(n_blocks == 1, wide).otherwise(F.lit(query_block))


def hybrid_retrieve(
    queries: DataFrame, corpus: DataFrame, top_k: int = P.TOP_K, *, lists: tuple[str, ...] = LISTS,
    exclude_self: bool = False, query_block: int = QUERY_BLOCK, case_block: int = SHARD, tokens_a_shard: int = TOKENS_A_SHARD,
) -> DataFrame:
    """Top cases per query with their ranks.

    ``queries``: query_id, text, amount, segment, industry, is_disputed, embedding; ``corpus``: invoice_id, case_text,
    amount, segment, industry, is_disputed, embedding. With ``exclude_self`` a query's own case (same id) is no candidate.
    """
    if case_block > 1 << PLACE_BITS:
        raise ValueError(f"a shard holds at most {1 << PLACE_BITS} cases")
    own = corpus.select(F.col("invoice_id").alias("query_id"), F.col("is_disputed").alias("own_disputed"))
    asked = queries.join(own, "query_id", "left") if exclude_self else queries.withColumn("own_disputed", F.lit(None).cast("boolean"))
    words = "bm25" in lists
    hashed = lambda text: F.transform(tokens(text), lambda t: F.xxhash64(t)) if words else F.array().cast("array<bigint>")
    stored = materialise(corpus.select(
        F.col("invoice_id").alias("doc_id"), level_keys(F.col("is_disputed")).alias("pools"), hashed(F.col("case_text")).alias("tokens"),
        F.ln("amount").alias("log_amount"), F.col("embedding").alias("vec"),
    ), "cases")
    sizes = stored.select(F.explode("pools").alias("pool"), F.size("tokens").alias("length"), F.size("vec").alias("numbers")).groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum("numbers").alias("numbers")
    )
    sizes = materialise(sizes, "pools")
    asked = choose_pools(asked, sizes.select("pool", "n")).select(
        "query_id", "pool", F.coalesce(hashed(F.col("text")), F.array().cast("array<bigint>")).alias("q_tokens"), F.ln("amount").alias("q_log_amount"), F.col("embedding").alias("q_vec"),
        F.when(F.lit(exclude_self), F.col("query_id")).alias("exclude_id"),
    )
    asked = materialise(asked, "asked")
    shards = F.greatest(
        F.ceil(F.col("n") / case_block), F.ceil(F.col("length") / tokens_a_shard), F.ceil(F.col("numbers") / NUMBERS_A_SHARD)
    ).cast("int")
    blocks = asked.groupBy("pool").agg(F.count(F.lit(1)).alias("q")).join(sizes.select("pool", "n", shards.alias("n_blocks")), "pool")
    blocks = blocks.select("pool", F.ceil(F.col("q") / block_queries(F.col("n"), F.col("n_blocks"), query_block, case_block)).cast("int").alias("q_blocks"), "n_blocks")
    # One short row per pool in use: bounded by segments times industries, read back instead of computed again.
    blocks = materialise(blocks, "blocks")
    cases = stored.withColumn("pool", F.explode("pools")).drop("pools").join(blocks, "pool")
    if lists == ("amount",):
        return _finish(nearest_amounts(asked, cases, top_k), lists, top_k)
    asked = asked.join(blocks, "pool")
    if words:
        # A task that has a whole pool weighs its queries' terms itself.
        counted = F.lit(exclude_self) | (F.col("n_blocks") > 1)
        weights = bm25_query_weights(asked.where(counted), cases.where(counted), exclude_self)
        weighed = asked.where(counted).join(weights, "query_id", "left").withColumn("q_tokens", F.lit(None).cast("array<bigint>"))
        means = materialise(bm25_mean_idf(cases.where(~counted)), "means")
        asked = weighed.unionByName(asked.where(~counted).join(means, "pool", "left"), allowMissingColumns=True)
    else:
        blank = {"terms": "array<bigint>", "weights": "array<double>", "avgdl": "double"}
        asked = asked.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}).drop("q_tokens")
    asked = materialise(asked, "weighed")

    def met(run, schema: str, q: DataFrame, c: DataFrame) -> DataFrame:
        spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = q.withColumn("qb", spread("query_id", "q_blocks")).withColumn("cb", every("n_blocks")).drop("q_blocks")
        right = c.withColumn("cb", spread("doc_id", "n_blocks")).withColumn("qb", every("q_blocks")).drop("q_blocks", "n_blocks")
        keys = ["pool", "qb", "cb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    pair = f"query_id {kind(queries, 'query_id')}, doc_id {kind(corpus, 'invoice_id')}"
    scores = ", ".join(f"s_{name} double" for name in lists)
    ranks = ", ".join(f"r_{name} double" for name in lists)
    seen = materialise(met(_best_of_shard(lists, top_k), f"{pair}, whole boolean, {scores}, {ranks}", asked, cases), "listed")
    held = ["query_id", "doc_id", *[f"{p}_{name}" for p in "sr" for name in lists]]
    final = seen.where("whole").join(asked.select("query_id"), "query_id").select(*held)

    # A rank is known in a pool of one shard, and for the best of all shards together.
    bound = len(lists) * (P.RRF_K + top_k) - P.RRF_K
    seen = seen.where("NOT whole").join(asked.select("query_id"), "query_id")
    for name in lists:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(f"s_{name}").desc(), "doc_id"))
        seen = seen.withColumn("_place", place)
        seen = seen.withColumn(f"r_{name}", F.when(F.col("_place") <= bound, F.col("_place").cast("double")))
    share = lambda name: 1.0 / (P.RRF_K + F.col(f"r_{name}"))
    low = sum((F.coalesce(share(name), F.lit(0.0)) for name in lists), F.lit(0.0))
    high = sum((F.coalesce(share(name), F.lit(1.0 / (P.RRF_K + bound + 1))) for name in lists), F.lit(0.0))
    of_query = Window.partitionBy("query_id")
    seen = seen.withColumns({"low": low, "high": high}).withColumn("_place", F.row_number().over(of_query.orderBy(F.col("low").desc())))
    nth = F.max(F.when(F.col("_place") == top_k, F.col("low"))).over(of_query)
    alive = seen.withColumn("nth", nth).where(F.col("nth").isNull() | (F.col("high") >= F.col("nth") - 1e-12))
    alive = materialise(alive.select(*held), "alive")
    unknown = reduce(lambda a, b: a | b, [F.col(f"r_{name}").isNull() for name in lists])
    packed = alive.where(unknown).groupBy("query_id").agg(
        F.collect_list(F.struct("doc_id", *[f"{p}_{name}" for p in "sr" for name in lists])).alias("candidates")
    )
    several = F.col("n_blocks") > 1
    better = met(
        _better_in_shard(lists), f"{pair}, " + ", ".join(f"b_{name} double" for name in lists),
        asked.where(several).join(packed, "query_id"), cases.where(several),
    )
    better = better.groupBy("query_id", "doc_id").agg(*[F.sum(f"b_{name}").alias(f"b_{name}") for name in lists])
    exact = alive.join(better, ["query_id", "doc_id"], "left").withColumns({f"r_{name}": F.coalesce(f"r_{name}", F.col(f"b_{name}") + 1) for name in lists})
    return _finish(final.unionByName(exact.select(*held)), lists, top_k)


def _finish(rows: DataFrame, lists: tuple[str, ...], top_k: int) -> DataFrame:
    """The best by reciprocal ranks, which are exact here."""
    fused = sum((1.0 / (P.RRF_K + F.col(f"r_{name}")) for name in lists), F.lit(0.0))
    top = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "doc_id")
    ranked = rows.withColumn("rrf_score", fused).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= top_k)
    names = [F.col(f"s_{name}") for name in lists] + [F.col(f"r_{name}").cast("bigint").alias(f"r_{name}") for name in lists]
    return ranked.select("query_id", "doc_id", *names, "rrf_score", "rank")


def archetype_cohesion(results: DataFrame, queries: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Share of retrieved cases with the query's archetype, next to what random picks would give. Diagnostic only.

    ``queries``: query_id; ``archetypes``: invoice_id, archetype of the whole population.
    """
    share = archetypes.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))
    share = share.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    mine = queries.select("query_id").join(archetypes.withColumnRenamed("invoice_id", "query_id"), "query_id")
    base = mine.join(share, "archetype").agg(F.avg("share").alias("baseline_rate"), F.count(F.lit(1)).alias("n_queries"))
    theirs = archetypes.select(F.col("invoice_id").alias("doc_id"), F.col("archetype").alias("case_archetype"))
    hits = results.join(mine, "query_id").join(theirs, "doc_id").agg(
        F.avg((F.col("archetype") == F.col("case_archetype")).cast("int")).alias("rate"), F.count(F.lit(1)).alias("n_retrieved")
    )
    total = hits.select(F.struct("rate", "n_retrieved")).scalar()
    return base.select(
        F.coalesce(total["rate"], F.lit(0.0)).alias("observed_cohesion_rate"), "baseline_rate", "n_queries",
        total["n_retrieved"].alias("n_retrieved"),
    )
