"""Nothing that the operators gather stops growing with the input, and rows are told apart by more than their id."""

import random

import pytest
from pyspark.sql import functions as F

from duewise.llm import mixing, neardup, quality, substrings


def test_quality_counts_every_trusted_document(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    n = 26_000
    docs = spark.createDataFrame([(i, "en", word()) for i in range(n + 300)], "doc_id long, lang string, text string")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = quality.classify(docs, labels).join(quality.trusted(labels), "doc_id", "left")
    seen, unseen = got.where("NOT calibrates").agg(F.max("perplexity")).first()[0], got.where("calibrates IS NULL").agg(F.percentile("perplexity", 0.2)).first()[0]
    assert seen < unseen


def test_quality_thresholds_by_language(spark):
    draw = random.Random(12)
    text = lambda signs: " ".join("".join(draw.choice(signs) for _ in range(5)) for _ in range(40))
    rows = [(i, "en", text("abc")) for i in range(300)] + [(300 + i, "xx", text("vwxyzäöüß")) for i in range(20)] + [(320 + i, None, text("vwxyzäöüß")) for i in range(20)] + [(340, "en", text("vwxyzäöüß"))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in (*range(300), 300, 301, 302)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert all(kept[i] for i in range(300, 340)) and not kept[340]


def test_quality_thresholds_are_exact_quantiles(spark):
    draw = random.Random(13)
    rows = [(lang, round(draw.uniform(2, 9), draw.choice((1, 6)))) for lang in ("en", "de", None, "") for _ in range({"en": 777, "de": 10, None: 50, "": 9}[lang])]
    held = spark.createDataFrame(rows, "lang string, perplexity double")
    want = {r["lang"]: r["p"] for r in held.groupBy("lang").agg(F.percentile("perplexity", 0.97).alias("p")).collect()}
    got = {r["lang"]: r["limit"] for r in quality.thresholds(held, 0.97).collect()}
    assert got == pytest.approx({k: want[k] for k in ("en", "de", None)})


def test_rows_without_id_and_repeated_ids_are_mixed_one_by_one(spark):
    rows = [(None, f"w{k} " * (5 + k % 7), "abc"[k % 3]) for k in range(60)] + [(None, "same text here", "a")] * 8 + [(7, f"x{k} " * 9, "b") for k in range(10)] + [(100 + k, "y " * 20, "c") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {n: sorted(map(str, mixing.mixed_documents(docs.repartition(n)).collect())) for n in (1, 5)}
    assert got[1] == got[5]
    # an id for each row gives the same words of every source, to less than a document of each
    numbered = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], docs.schema)
    words = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    mine, want = words(mixing.mixed_documents(docs)), words(mixing.mixed_documents(numbered))
    assert set(mine) == set(want) and all(abs(mine[s] - want[s]) < 40 for s in want)


def test_near_duplicates_go_by_text_not_by_id(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    rows = [(None, text(1))] * 3 + [(None, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (6, text(4)), (None, text(3)), (8, ""), (8, ""), (9, None), (None, ""), (None, "")]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted([(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (8, ""), (9, None), (None, ""), (None, "")], key=key)


def test_substrings_of_rows_without_id_and_of_repeated_ids(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    own = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    for doc_id in (None, 4):  # the same passage at the same offset
        rows = [(doc_id, f"{own(k)} {passage}") for k in range(3)]
        got = substrings.deduplicated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r["n_removed"] for r in got) == [0, 30, 30] and {r["doc_id"] for r in got} == {doc_id}
    got = substrings.deduplicated_words(spark.createDataFrame([(None, own(1))] * 3 + [(None, own(2))], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 30, 30]


def test_quality_judges_rows_without_id_and_of_repeated_ids_one_by_one(spark):
    prose = "the people of the city were glad that the work on the river had been done before the winter came. "
    good = [(i, prose[i % 7 :] * 8, "en") for i in range(60)]
    odd = [(None, prose * 9, "en"), (None, "zq#x9 " * 80, "en"), (None, None, "en"), (100, "kk%%jj vv" * 50, "en"), (100, prose[2:] * 7, "en")]
    docs = spark.createDataFrame([*good, *odd], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = [(r["doc_id"], r["text"]) for r in quality.good_documents(docs, labels).collect()]
    assert (None, odd[0][1]) in kept and (100, odd[4][1]) in kept and (3, good[3][1]) in kept
    assert all((r[0], r[1]) not in kept for r in (odd[1], odd[2], odd[3]))


def test_rows_of_a_group_below_the_threshold_follow_its_size_not_its_pairs(spark, monkeypatch):
    draw, n = random.Random(4), 300
    base = [f"b{j}" for j in range(1000)]
    texts = []
    for k in range(n):
        words = list(base)
        for j in draw.sample(range(1000), 15):
            words[j] = f"{k}x{j}"
        texts.append(words)
    sets = [{tuple(w[j : j + 3]) for j in range(998)} for w in texts]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (2 * 998 - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    sizes, write = {}, neardup.materialise

    def counted(df, name):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    got = neardup.near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string"), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {k: root(k) for k in range(n)}
    assert sizes["likely"][-1] < n * (n - 1) / 4 and sizes["links"][-1] < n
