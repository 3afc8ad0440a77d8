"""The manifest against a tree built with hashlib, group by group."""

import hashlib
import zlib

import pytest

from duewise.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(nodes):
    """The root, and for each leaf the siblings before and after it on every level."""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, below = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for k, leaves in enumerate(at[i : i + 3]):
                for x in leaves:
                    proofs[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha(*run))
            below.append([x for leaves in at[i : i + 3] for x in leaves])
        nodes, at = parents, below
    return nodes[0], proofs


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(b"" if r["source"] is None else b"1" + r["source"].encode(), []).append(r)
    parts = []
    for name in sorted(groups):
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        parts.append((own, *tree([leaf(r, r["text"]) for r in own])))
    root, above = tree([p[1] for p in parts])
    out = []
    for (own, subroot, proofs), upper in zip(parts, above, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            whole, text = proof + upper, r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for before, after in whole:
                node = sha(before, node, after)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha(*[b + a for b, a in whole]), node, node == root))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in merkle.verified_documents(docs).collect()), key=str)


def test_whole_table(documents):
    assert got(documents) == plain(documents.collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_several_blocks_of_levels(documents, odd, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    same = documents.select("doc_id", "text", "lang", "source", "n_chars").replace({"src1": "src0", "src2": "src0", "src3": "src0"}, subset=["source"])
    assert got(same) == plain(same.collect())


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_of_a_lone_group(spark, count, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    docs = spark.createDataFrame([(i * 7, f"a\n{i}", "en", None, i) for i in range(count)], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(docs) == plain(docs.collect())


def test_odd_rows(odd):
    docs = odd.drop("n").selectExpr("*", "length(text) AS n_chars", "1 AS idx", "2 AS digest", "3 AS root", "4 AS chunk")
    assert got(docs) == plain(docs.collect())
    assert got(docs.where("false")) == []


def test_any_change_is_found(documents):
    rows = merkle.verified_documents(documents).collect()
    touched = {r["doc_id"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")}
    assert touched and {r["doc_id"] for r in rows if not r["verified"]} == touched
