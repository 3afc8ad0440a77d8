"""Divergence of sources against counts in plain Python."""

import random
import re
from collections import Counter

import pytest

from duewise.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=30, top=50):
    counts, docs = {}, {}
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        found = TERM.findall((r["text"] or "").translate(UPPER))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        docs.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c, total: 1 + (10**9 * (c + 5)) // (total + 5 * len(kept))  # noqa: E731, B023
        p = {g: {t: share(c[t], sum(c[x] for x in kept)) for t in kept} for g, c in groups.items()} if kept else {g: {} for g in groups}
        whole = sum(groups.values(), Counter())
        q = {t: share(whole[t], sum(whole[x] for x in kept)) for t in kept}
        for g, c in groups.items():
            pairs = [(h, sum(abs(p[g][t] - p[h][t]) for t in kept)) for h in groups if h != g]
            own = [(t, p[g][t] - q[t]) for t in kept if c[t] and p[g][t] > q[t]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def got(docs, **more):
    return sorted(tuple(r) for r in divergence.divergence(docs, **more).collect())


def corpus(seed, sources, words, rows):
    draw = random.Random(seed)
    out = []
    for i in range(rows):
        lang = draw.choice(["en", "en", "de"])
        own = [f"w{'abcdefghij'[int(len(words) * draw.random() ** 3) % 10]}" if draw.random() < 0.2 else words[int(len(words) * draw.random() ** 3)] for _ in range(draw.randint(0, 80))]
        out.append((i, draw.choice([", ", " ", "\n", "1"]).join(own), lang, f"s{int(sources * draw.random() ** 2)}"))
    return out


@pytest.mark.parametrize(("sources", "tile", "slab"), [(4, 32, 256), (9, 2, 1), (7, 3, 2)])
def test_pairs_and_terms(spark, monkeypatch, sources, tile, slab):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "SLAB", slab)
    words = [a + b + c for a in "abcdeÉß😀" for b in "XyzK" for c in "opqrst"]
    docs = spark.createDataFrame(corpus(sources, sources, words, 300), "doc_id long, text string, lang string, source string")
    assert got(docs, least=5) == plain(docs.collect(), least=5)


def test_partial_counts_add_up(documents, monkeypatch):
    want = got(documents, least=3)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert got(documents, least=3) == want == plain(documents.collect(), least=3)


def test_odd_rows(spark, odd):
    assert got(odd) == plain(odd.collect()) and any(r[2] == "pair" for r in got(odd))
    assert got(odd, least=1) == plain(odd.collect(), least=1)
    assert got(odd.where("false")) == []
    lone = spark.createDataFrame([(1, "aa bb", None, None)], "doc_id long, text string, lang string, source string")
    assert got(lone) == [] and got(lone, least=1) == plain(lone.collect(), least=1)


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**15, 3 * 10**15 + 7, 12)], "n long, total long, kept long")
    assert row.select(divergence._share("n", "total", "kept")).first()[0] == 1 + (10**9 * (10**15 + 5)) // (3 * 10**15 + 7 + 60)
