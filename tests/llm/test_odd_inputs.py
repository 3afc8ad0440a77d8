"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator and stage."""

import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duewise.llm import fingerprint, langid, mixing, neardup, packing, quality, records, secrets, substrings, topk

PER_ROW = {
    "mixing": mixing.mix_sources, "fingerprint": fingerprint.fingerprints, "secrets": secrets.scan, "neardup": neardup.near_duplicates,
    "langid": langid.identify_documents, "records": records.token_records, "substrings": substrings.deduplicated_words,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(odd, name):
    rows = PER_ROW[name](odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    six = [r.asDict() for r in rows if r["doc_id"] == 6]
    same = {"mixing": ["size", "target"], "records": ["n_tokens", "ids_crc32"], "fingerprint": ["fingerprint"]}.get(name, list(six[0]))
    assert all(six[0][c] == six[1][c] for c in same)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(odd, name):
    assert PER_ROW[name](odd.where("false")).collect() == []


def test_defined_results(odd):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    found = by(langid.identify_documents(odd))
    assert all((found[k]["lang_pred"], found[k]["score"]) == ("und", 0.0) for k in (2, 3, 4))
    print_ = by(fingerprint.fingerprints(odd))
    assert print_[2]["fingerprint"] == print_[3]["fingerprint"] == "" and print_[2]["n_chars"] == 0 and print_[1]["fingerprint"] == print_[6]["fingerprint"]
    assert print_[3]["near_next"] == 1.0 and print_[1]["near_next"] > 0.9  # 3 is followed by 2, 1 by the longer of the rows without id
    near = by(neardup.near_duplicates(odd, words=3, percent=85))
    assert near[6]["component_id"] == 1 and not near[6]["kept"] and near[2]["n_shingles"] == 0 and near[3]["component_id"] == 3 and near[9]["component_id"] == 8
    cut = by(substrings.deduplicated_words(odd))
    assert cut[1]["n_removed"] == 0 and cut[6]["n_removed"] == cut[6]["n_words"] == 60 and cut[None]["n_removed"] in (0, 60) and cut[9]["n_removed"] == 0
    seen = by(secrets.scan(odd))
    assert (seen[10]["n_access"], seen[10]["n_hex"]) == (1, 1) and "guess:" in seen[10]["spans"] and seen[2]["spans"] == ""


def test_quality(odd, labels):
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all((r["perplexity"] is None) == (not r["n_signs"]) for r in rows)
    assert not any(r["kept"] for r in rows if r["perplexity"] is None)
    assert all(r["kept"] for r in quality.classify(odd, labels.where("false")).collect() if r["n_signs"])
    assert quality.classify(odd.where("false"), labels).collect() == []


def test_packing(odd):
    rows = packing.pack_documents(odd).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()} and packing.pack_documents(odd.where("false")).collect() == []


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [inf, 1.0]), (200, [nan, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, [0.5]), (None, [1.0, 1.0]), (0, [3.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).collect()
    assert {r["query_id"] for r in got} == {0} and all(r["vec_id"] in (1, 2, 3, 4) for r in got)
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in got)[:2]
    assert [x[1] for x in first] == [1, 1] or [x[1] for x in first] == [1, 2]
    assert topk.top_k(topk.quantised(df.where("false")), F.col("vec_id") % 50 == 0).collect() == []


def test_stages_keep_columns_and_run_on_odd_and_empty_tables(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.schema.names == docs.schema.names
            docs.sparkSession.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_near_duplicates_give_workers_memory_back(spark, tmp_path, monkeypatch):
    """Workers are reused by later stages, so the Python of a stage leaves no freed memory behind."""
    monkeypatch.setattr(neardup, "give_back", lambda at=str(tmp_path): open(f"{at}/{sys._getframe(1).f_code.co_qualname.split('.')[0]}", "w").close())
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(4)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), 3, 80).collect()
    assert {r.component_id for r in found} == {0}
    assert {p.name for p in tmp_path.iterdir()} >= {"sketches", "shingle_sets", "_of_class", "_likely", "_confirmed"}
