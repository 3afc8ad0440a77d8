"""Retrieval against brute force, with blocks small enough that pools span several."""

import math
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import retrieval as R

WORDS = "late paid email voice retail invoice amount terms prior rate closed reminder stress oversight".split()
CASE = "invoice_id BIGINT, case_text STRING, amount DOUBLE, segment STRING, industry STRING, is_disputed BOOLEAN, embedding ARRAY<FLOAT>"
ASK = "query_id BIGINT, text STRING, amount DOUBLE, segment STRING, industry STRING, is_disputed BOOLEAN, embedding ARRAY<FLOAT>"


def make(rng, i, hot=0.7):
    text = " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randrange(3, 12))) + f" {rng.randrange(40)}"
    segment = "A" if rng.random() < hot else rng.choice("BC")
    vector = [round(rng.gauss(0, 1), 3) for _ in range(6)]
    return (i, text, float(rng.choice([100, 200, 500, 900]) + rng.randrange(50)), segment, rng.choice("xy"), rng.random() < 0.1, vector)


def tok(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def bm25(corpus, query):
    docs = [tok(c[1]) for c in corpus]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = P.BM25_EPSILON * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    score = lambda d: sum(idf.get(t, 0.0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in tok(query))
    return [score(d) for d in docs]


def pool(q, corpus, exclude):
    rest = [c for c in corpus if not exclude or c[0] != q[0]]
    same = [lambda c: c[3] == q[3] and c[4] == q[4], lambda c: c[3] == q[3], lambda c: True]
    levels = ([lambda c, f=f: c[5] and f(c) for f in same] if q[5] else []) + same
    for level in levels:
        found = [c for c in rest if level(c)]
        if len(found) >= P.MIN_CANDIDATES:
            return found
    return found


def brute(q, corpus, k, exclude=False):
    import numpy as np

    cand = sorted(pool(q, corpus, exclude))
    v = lambda x: np.array(x[6], dtype=np.float32).astype(float)
    cos = [round(float(v(c) @ v(q) / np.linalg.norm(v(c)) / np.linalg.norm(v(q))), 9) for c in cand]
    layers = [cos, [round(s, 9) for s in bm25(cand, q[1])], [-round(abs(math.log(c[2]) - math.log(q[2])), 9) for c in cand]]
    ranks = []
    for layer in layers:
        order = sorted(range(len(cand)), key=lambda i: (-layer[i], cand[i][0]))
        ranks.append({i: n for n, i in enumerate(order, 1)})
    fused = {i: sum(1 / (P.RRF_K + r[i]) for r in ranks) for i in range(len(cand))}
    best = sorted(fused, key=lambda i: (-round(fused[i], 12), cand[i][0]))[:k]
    return [(cand[i][0], *[r[i] for r in ranks]) for i in best]


def check(spark, queries, corpus, k, exclude=False, **blocks):
    got = {}
    found = R.hybrid_retrieve(spark.createDataFrame(queries, ASK), spark.createDataFrame(corpus, CASE), k, exclude_self=exclude, **blocks)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.r_vector, r.r_bm25, r.r_amount))
    for q in queries:
        assert got[q[0]] == brute(q, corpus, k, exclude), q


@pytest.mark.parametrize("blocks", [{}, {"query_block": 7, "case_block": 40}, {"tokens_a_shard": 700}])
def test_equals_brute_force_with_a_hot_segment(spark, blocks):
    rng = random.Random(11)
    corpus = [make(rng, i) for i in range(400)]
    check(spark, [make(rng, 10_000 + i) for i in range(25)], corpus, 5, **blocks)


@pytest.mark.parametrize("blocks", [{}, {"query_block": 5, "case_block": 50}])
def test_equals_brute_force_without_the_own_case(spark, blocks):
    rng = random.Random(12)
    corpus = [make(rng, i) for i in range(300)]
    check(spark, corpus[:12], corpus, 5, exclude=True, **blocks)


def test_own_case_is_taken_out_of_words_that_every_case_has(spark):
    rng = random.Random(17)
    corpus = [(c[0], f"segment industry {c[1]}", *c[2:]) for c in (make(rng, i) for i in range(150))]
    check(spark, corpus[:10], corpus, 5, exclude=True)


def test_many_equal_cases_keep_exact_ranks(spark):
    rng = random.Random(13)
    one = make(rng, 0)
    corpus = [(i, *one[1:5], False, one[6]) for i in range(500)] + [make(rng, 500 + i) for i in range(60)]
    check(spark, [(9_000, *one[1:5], False, one[6]), make(rng, 9_001)], corpus, 5, query_block=1, case_block=64)


def test_own_case_ranks_first_unless_excluded_and_the_pool_is_never_empty(spark):
    rng = random.Random(14)
    corpus = [make(rng, i) for i in range(80)]
    asked = [corpus[3][:5] + (False, corpus[3][6])]
    df = spark.createDataFrame(corpus, CASE)
    first = R.hybrid_retrieve(spark.createDataFrame(asked, ASK), df, 1).first()
    assert first.doc_id == 3
    other = R.hybrid_retrieve(spark.createDataFrame(asked, ASK), df, 1, exclude_self=True).first()
    assert other.doc_id != 3
    strange = [(77, "nothing in common", 5.0, "no segment", "no industry", True, [1.0] * 6)]
    assert R.hybrid_retrieve(spark.createDataFrame(strange, ASK), df, 5).count() == 5


def test_single_lists(spark):
    rng = random.Random(15)
    corpus = [make(rng, i) for i in range(200)]
    query = make(rng, 999)
    for name, layer in (("vector", 1), ("bm25", 2), ("amount", 3)):
        found = R.hybrid_retrieve(spark.createDataFrame([query], ASK), spark.createDataFrame(corpus, CASE), 3, lists=(name,), case_block=30)
        got = [r.doc_id for r in found.orderBy("rank").collect()]
        want = sorted(brute(query, corpus, 10_000), key=lambda row: row[layer])[:3]
        assert got == [w[0] for w in want]


def test_no_pair_rows_in_the_plan(spark):
    rng = random.Random(16)
    corpus = spark.createDataFrame([make(rng, i) for i in range(50)], CASE)
    plan = R.hybrid_retrieve(spark.createDataFrame([make(rng, 99)], ASK), corpus, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join Cross" not in plan


def test_cases_and_queries_without_direction_or_amount_take_part(spark):
    rng = random.Random(9)
    corpus = [make(rng, i, hot=1.0) for i in range(30)]
    corpus[4] = (*corpus[4][:6], [0.0] * 6)
    corpus[7] = (corpus[7][0], corpus[7][1], None, *corpus[7][3:])
    queries = [(*make(rng, 100)[:6], [0.0] * 6), make(rng, 101)]
    found = R.hybrid_retrieve(spark.createDataFrame(queries, ASK), spark.createDataFrame(corpus, CASE), 30)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert set(got) == {100, 101} and all(len(ids) >= P.MIN_CANDIDATES for ids in got.values())
    assert any({4, 7} <= ids for ids in got.values())


def test_an_index_reads_only_blocks_that_can_hold_a_better_case():
    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(3)
    cases = pd.Series([np.concatenate([draw.integers(0, 6, draw.integers(2, 9)), draw.integers(100, 400, 2)]) for _ in range(20_000)])
    terms, weights = np.array([0, 1, 2, 150, 151, 390]), np.array([0.02, 0.03, 0.01, 7.0, 5.0, 6.0])
    index = R.PostingBlocks(cases, terms)
    index.weigh(7.0)
    search = index.best(np.arange(6), weights, 40, out=17)
    norm = P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * cases.map(len).to_numpy() / 7.0)
    tf = np.stack([cases.map(lambda c, t=t: int((c == t).sum())).to_numpy() for t in terms])
    scores = (weights[:, None] * tf * (P.BM25_K1 + 1) / (tf + norm)).sum(axis=0)
    want = [i for i in np.lexsort((np.arange(20_000), -np.round(scores, 9))) if i != 17][:40]
    assert search.found.tolist() == want
    assert search.done.sum() * 4 < index.blocks
    got, ranks = index.ranked(search, np.array(want[:5] + [17]))
    assert np.allclose(got, scores[want[:5] + [17]]) and ranks[:5].tolist() == [1, 2, 3, 4, 5]


def test_what_leaves_a_task_is_bounded(spark, monkeypatch):
    rng = random.Random(21)
    corpus = [make(rng, i, hot=1.0) for i in range(3000)]
    asked = [make(rng, 10_000 + i, hot=1.0) for i in range(4)]
    left = {}
    write = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name: left.setdefault(name, write(df, name)))
    check(spark, asked, corpus, 2, case_block=800)
    bound = 3 * (P.RRF_K + 2) - P.RRF_K
    shards = left["blocks"].collect()[0]["n_blocks"]
    assert shards > 1 and left["listed"].groupBy("query_id").count().where(f"count > {3 * bound * shards}").count() == 0
    left.clear()
    check(spark, asked, corpus, 2)
    assert left["listed"].groupBy("query_id").count().where(f"count > {bound}").count() == 0  # beaten candidates stay in their task


@pytest.mark.parametrize("values", ["spread", "few"])
def test_closest_amounts(spark, values):
    rng = random.Random(31)
    amount = lambda: rng.choice([None, 0.0, 100.0, 100.5, 250.0]) if values == "few" else rng.choice([None, 0.0, round(rng.lognormvariate(6, 2), 2)])
    cases = [(i, rng.choice("pq"), amount()) for i in range(1500)]
    asked = [(i, rng.choice("pq"), amount()) for i in range(40)]
    frame = lambda rows, key, value: spark.createDataFrame(rows, f"{key} long, pool string, amount double").selectExpr(key, "pool", f"ln(amount) AS {value}")
    found = {}
    near = R.nearest_amounts(frame(asked, "query_id", "q_log_amount").selectExpr("*", "query_id * 3 AS exclude_id"), frame(cases, "doc_id", "log_amount"), 7)
    for r in near.collect():
        found.setdefault(r.query_id, []).append((r.r_amount, r.doc_id))
    away = lambda a, b: math.inf if not a or not b else round(abs(math.log(a) - math.log(b)), 9)
    for key, pool_, value in asked:
        order = sorted((away(value, a), i) for i, p, a in cases if p == pool_ and i != key * 3)
        assert [d for _, d in sorted(found[key])] == [i for _, i in order[:7]]


def test_closest_amounts_read_no_more_in_a_larger_pool(spark):
    for n in (2_000, 20_000):
        cases = spark.range(n).selectExpr("id AS doc_id", "concat('p', id % 2) AS pool", "ln(100 + id / 7) AS log_amount")
        asked = spark.range(20).selectExpr("id AS query_id", "concat('p', id % 2) AS pool", "ln(150 + id) AS q_log_amount", "cast(null AS long) AS exclude_id")
        read = R.amounts_around(asked, R._amount_values(cases, 6), 6).groupBy("query_id").count()
        assert read.count() == 20 and read.where("count > 36").count() == 0


def test_cases_are_not_copied_for_every_few_queries(spark):
    """A pool of one small shard meets few blocks of many queries, so that copies of its cases stay in proportion; several shards keep short blocks."""
    pools = spark.createDataFrame([(25_000, 1), (65_536, 1), (200_000, 4), (0, 1), (1, 1)], "n LONG, n_blocks INT")
    got = [r[0] for r in pools.select(R.block_queries(F.col("n"), F.col("n_blocks"), R.QUERY_BLOCK, R.CASE_BLOCK).cast("long")).collect()]
    assert got == [10_737, 4_096, 512, 16_384, 16_384]


def test_an_index_is_built_from_some_tokens_at_a_time(monkeypatch):
    """Beside the tokens, memory follows the postings that are asked for; the index does not depend on the pieces."""
    rng = np.random.default_rng(5)
    cases = pd.Series([rng.integers(0, 100_000, n) for n in [0, 30_000, *rng.integers(0, 1000, 4000), 0]])
    terms = np.arange(0, 100_000, 1000)
    tracemalloc.start()
    index = R.PostingBlocks(cases, terms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(map(len, cases))  # less than one more copy of the tokens
    monkeypatch.setattr(R, "TOKENS_AT_ONCE", 1 << 60)
    whole = R.PostingBlocks(cases, terms)
    for name in ("case", "term", "tf", "starts", "order", "common", "lengths"):
        assert np.array_equal(getattr(index, name), getattr(whole, name)), name
    owner = np.repeat(np.arange(len(cases)), cases.map(len))
    flat = np.concatenate(cases.to_list())
    asked = np.isin(flat, terms)
    assert index.tf.sum() == asked.sum() and len(index.tf) == len(set(zip(owner[asked].tolist(), flat[asked].tolist())))


def drawn(rng, n, queries, own):
    """A shard with equal vectors, texts and amounts, unknown amounts, vectors without direction, and queries; ids are apart."""
    vectors = rng.normal(size=(n, 6)).astype(np.float32)
    vectors[rng.integers(0, n, n // 3)] = vectors[0]
    vectors[rng.integers(0, n, 20)] = 0
    tokens = [np.concatenate([rng.integers(0, 5, rng.integers(0, 9)), rng.integers(100, 300, 2)]) for _ in range(n)]
    amounts = np.where(rng.random(n) < 0.5, rng.normal(size=n), rng.integers(0, 9, n) * 0.5)
    amounts[rng.integers(0, n, 50)] = np.nan
    c = pd.DataFrame({"doc_id": np.arange(n) * 3, "tokens": tokens, "log_amount": amounts, "vec": list(vectors)})
    lengths = c["tokens"].map(len)
    q = pd.DataFrame({
        "query_id": np.arange(queries) * 30, "pool": "p", "n_blocks": 1, "q_vec": list(rng.normal(size=(queries, 6)).astype(np.float32)),
        "q_log_amount": rng.integers(0, 9, queries) * 0.5, "exclude_id": [i * 30 if own else None for i in range(queries)],
        "terms": [np.array([0, 1, 2, 3, 4, *t]) for t in rng.integers(100, 300, (queries, 3))],
        "weights": [rng.random(8) + np.array([0] * 5 + [3] * 3) for _ in range(queries)], "avgdl": float(lengths.mean()),
    })
    q["terms"], q["weights"] = [np.unique(t) for t in q["terms"]], [w[: len(np.unique(t))] for t, w in zip(q["terms"], q["weights"])]
    q.at[1, "q_vec"], q.loc[2, "q_log_amount"] = np.zeros(6, np.float32), np.nan
    return q, c


def ranks_of_all(q, c):
    """Every case's ranks by sorting the whole shard."""
    unit = lambda v: np.divide(v.astype(float), np.linalg.norm(v.astype(float)), where=v.any(), out=np.zeros(len(v)))
    cosines = np.array([unit(v) for v in c["vec"]]) @ unit(q["q_vec"])
    norm = P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * c["tokens"].map(len).to_numpy() / q["avgdl"])
    words = np.zeros(len(c))
    for t, w in zip(q["terms"], q["weights"]):
        tf = np.array([(x == t).sum() for x in c["tokens"]])
        words += w * tf * (P.BM25_K1 + 1) / (tf + norm)
    ranks = []
    for scores in (cosines, words, -np.abs(c["log_amount"].to_numpy() - q["q_log_amount"])):
        order = np.lexsort((c["doc_id"], np.where(np.isnan(scores), np.inf, -np.round(scores, 9))))
        order = order[c["doc_id"].to_numpy()[order] != q["exclude_id"]]
        ranks.append({int(c["doc_id"].iat[i]): n for n, i in enumerate(order, 1)})
    return ranks


@pytest.mark.parametrize("own", [False, True])
def test_a_pool_of_one_shard_leaves_only_winners_with_exact_ranks(monkeypatch, own):
    """No rank is left to a second pass, whatever ties, samples and errors there are on the way."""
    q, c = drawn(np.random.default_rng(7), 6_000, 6, own)
    monkeypatch.setattr(R, "SAMPLE", 300, raising=False)
    found = R._best_of_shard(R.LISTS, 5)(q, c.sample(frac=1.0, random_state=1))
    assert not found[["r_vector", "r_bm25", "r_amount"]].isna().any().any()
    assert len(found) == 5 * len(q)
    for _, row in q.iterrows():
        ranks = ranks_of_all(row, c)
        fused = {i: sum(1.0 / (P.RRF_K + r[i]) for r in ranks) for i in ranks[0]}
        want = sorted(fused, key=lambda i: (-round(fused[i], 12), i))[:5]
        got = found[found["query_id"] == row["query_id"]]
        assert {int(r.doc_id): (r.r_vector, r.r_bm25, r.r_amount) for r in got.itertuples()} == {i: tuple(r[i] for r in ranks) for i in want}


@pytest.mark.parametrize("own", [False, True])
def test_better_cases_of_a_shard_are_counted(own):
    q, c = drawn(np.random.default_rng(8), 3_000, 4, own)
    rng, pairs = np.random.default_rng(9), []
    for _, row in q.iterrows():
        ranks, some = ranks_of_all(row, c), [int(i) for i in rng.choice(c["doc_id"], 40, replace=False) if i != row["exclude_id"]]
        pairs.append([(i, [r[i] for r in ranks]) for i in some])
    shard = R.Shard(R.LISTS, q, c)
    for rows in shard.batches:
        shard.score(rows)
        at = np.repeat(np.arange(len(rows)), [len(pairs[i]) for i in rows])
        places = np.array([i // 3 for n in rows for i, _ in pairs[n]])
        want = np.array([r for n in rows for _, r in pairs[n]])
        for n, name in enumerate(R.LISTS):
            scores = shard.scores[name]
            assert (scores.ahead(at, scores.exact(at, places), places) + 1).tolist() == want[:, n].tolist(), name
            if name != "bm25":
                assert (scores.ahead_at_least(at, places) < want[:, n]).all()


def test_a_task_with_a_whole_pool_weighs_terms_itself(spark, monkeypatch):
    """Terms of queries over pools of one shard meet no table; weights equal those that tables give."""
    rng = random.Random(23)
    corpus, asked = [make(rng, i, hot=1.0) for i in range(200)], [make(rng, 10_000 + i, hot=1.0) for i in range(6)]
    left, write = {}, R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name: left.setdefault(name, write(df, name)))
    check(spark, asked, corpus, 5)
    assert left["weighed"].where("terms IS NOT NULL").count() == 0
    cases = left["cases"].selectExpr("explode(pools) AS pool", "*")
    want = {r.query_id: r for r in R.bm25_query_weights(left["asked"], cases, False).collect()}
    for (pool_,), q in left["weighed"].toPandas().groupby(["pool"]):
        c = cases.where(F.col("pool") == pool_).toPandas()
        index, words, weights, means = R._index(q, c)
        terms = np.unique(np.concatenate(q["q_tokens"].to_list()))
        for key, w, weight, mean in zip(q["query_id"], words, weights, means, strict=True):
            table = dict(zip(want[key].terms, want[key].weights))
            assert table == pytest.approx(dict(zip(terms[w].tolist(), weight.tolist()))) and mean == pytest.approx(want[key].avgdl)
