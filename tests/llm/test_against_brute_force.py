"""Each operator that SQL cannot express, held against a plain version over the smallest test tables or a small corpus with planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from duewise.llm import catalog, fingerprint, langid, mixing, neardup, packing, quality, records, secrets, substrings
from duewise.llm.components import components
from duewise.llm.tokens import Encoder, default_tokenizer
from tools.check_queries import normal

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", "   ", "it's don't IT'S l'eau", "a²b³ ½", "<|endoftext|> x", "ΑΣ ΣΑΣ ΟΔΟΣ", "İstanbul ſ K", "é café", "x y z", "a\x1cb\x85d", "foo_bar12_3 _ __ _a 1_2", "日本語 テスト", "á ́b", "№5 ™ ﬁ", "<| endoftext |>", "😀😀 a😀b", "x­y​z"]


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def planted(spark):
    """Documents with shared passages, near copies, copies and repeats inside, ids out of order."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(3000)]
    make = lambda n: [draw.choice(words) for _ in range(n)]
    passage, base = make(60), make(300)
    docs = [make(draw.randint(1, 200)) for _ in range(60)]
    docs += [make(30) + passage + make(40) for _ in range(12)] + [passage[:25] + make(5), make(9) + passage[-21:], passage + passage]
    for k in range(40):  # near copies of one text, most of them less alike among each other than to the text
        copy = list(base)
        for _ in range(draw.randint(0, 14)):
            copy[draw.randrange(300)] = draw.choice(words)
        docs.append(copy)
    docs += [list(docs[3]), list(docs[70]), docs[70][:-1]]
    ids = draw.sample(range(1000), len(docs))
    seps = [" ", "\n", "  "]
    return spark.createDataFrame([(i, draw.choice(seps).join(d)) for i, d in zip(ids, docs, strict=True)], "doc_id long, text string")


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df = catalog.QUERIES[key](spark, sf)
    cur = con.execute(catalog.ORACLES[key])
    names = [c[0] for c in cur.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)


def test_curriculum_positions(spark, documents):
    mixed = mixing.mix(mixing.word_sizes(documents), schedules=(((0, 1), (0.5, 3), (1, 0)), ((0, 0.0), (1, 4))))
    rows = mixing.copies(mixed).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and all(0 <= r["position"] < 1 for r in rows)
    total = sum(r["words"] for r in rows)
    assert abs(total - 1.5 * mixed.agg(F.sum("size")).first()[0]) < 30
    one = sorted((r["position"], r["words"]) for r in rows if r["source"] == "src1")  # a ramp from 0: half its words by sqrt(1/2)
    assert abs(sum(w for p, w in one if p < math.sqrt(0.5)) / sum(w for _, w in one) - 0.5) < 0.2


def test_fingerprints(texts, documents):
    def hashed(words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h >> 1

    def sketch(text):
        words = WORD.findall(text)
        return sorted({hashed(words[i : i + 5]) for i in range(len(words) - 4)})[: fingerprint.K] if len(words) >= 5 else None

    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(documents).collect()}
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        s, e, n = map(sketch, (text, edited, after))
        if None in (s, e, n):
            continue
        assert got[i]["fingerprint"] == "".join(f"{x:016x}" for x in s)
        for near, other in (("near_edited", e), ("near_next", n)):
            union = sorted(set(s) | set(other))[: fingerprint.K]
            assert got[i][near] == pytest.approx(len(set(union) & set(s) & set(other)) / len(union))


def test_sketches_merge_and_estimate(spark):
    df = spark.range(1).select(F.lit(" ".join(f"w{i}" for i in range(3000))).alias("a"), F.lit(" ".join(f"w{i}" for i in range(1500, 4500))).alias("b"))
    df = df.select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"), fingerprint.sketch(F.lit(" ".join(f"w{i}" for i in range(4500)))).alias("all"))
    r = df.select("all", fingerprint.merge(F.col("a"), F.col("b")).alias("m"), fingerprint.merge_all(F.array("b", "a")).alias("m2"), fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n")).first()
    assert r["all"] == r["m"] == r["m2"] and abs(r["j"] - 1 / 3) < 0.13 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] - 2996) < 900


def test_kneser_ney_probabilities(spark):
    train = ["abracadabra", "a cab and a bar", "dad had a card", "bad cab"]
    counts = quality.Counts(quality.count_runs(spark.createDataFrame([(t,) for t in train], "text string"), 3), 3)
    order, bits = 3, quality.BITS
    plain = Counter(int(x) for t in train for x in quality.runs(t, order))
    tables = {order: plain}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(x & ((1 << bits * k) - 1) for x in tables[k + 1])

    def p(run, k):
        if k == 0:
            return 1 / (1 << bits)
        of = Counter(tables[k].values())
        d = quality.discounts(*(of[j] for j in (1, 2, 3, 4)))
        context = [c for x, c in tables[k].items() if x >> bits == run >> bits]
        low = p(run & ((1 << bits * (k - 1)) - 1), k - 1)
        if not context:
            return low
        c = tables[k].get(run, 0)
        left = sum(d[min(x, 3) - 1] for x in context) / sum(context)
        return (c - (d[min(c, 3) - 1] if c else 0)) / sum(context) + left * low

    docs = spark.createDataFrame([(1, "en", "a bad card"), (2, "en", "zzz"), (3, "en", "abra cab")], "doc_id long, lang string, text string")
    for r in quality.perplexities(docs, counts).collect():
        text = {1: "a bad card", 2: "zzz", 3: "abra cab"}[r["doc_id"]]
        want = math.exp(-np.mean([math.log(p(int(x), order)) for x in quality.runs(text, order)]))
        assert r["perplexity"] == pytest.approx(want)
    every = [(int(plain.most_common(1)[0][0]) >> bits << bits) | s for s in range(1 << bits)]
    assert sum(p(x, order) for x in every) == pytest.approx(1)


def test_quality_rejects_what_labels_call_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.25


def test_secret_spans(texts):
    def brute(text):
        out = []
        for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
            out += [(m.start(), 0, m.end())] * (len(m[1]) >= 6)
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return sorted(out)

    odd = ["secret: token: abcdefg", "token=token=abcdef", "API_KEY = 'abc' passwd:abcdefgh", "AKIAAKIA" + "B" * 16, "deadbeef" * 3 + "g" + "a" * 23, "ſecret: abcdefgh"]
    for text in [*texts.values(), *odd]:
        assert brute(text) == [s for s in secrets.find(text, default_tokenizer()) if s[1] < 3]


def test_guess_cost():
    words = secrets.dictionary(default_tokenizer())
    bits = lambda v: secrets.guess_bits(v, words)
    weak = ["summer2024", "qwertyuiop", "aaaaaaaaaa", "abcabcabc", "password123", "1987-05-12", "abcdefgh", "x" * 3000, "zxcvbnm,./"]
    strong = ["x9Qe7#kLm2Vb", "wJalrXUtnFEMI/K7MDENG", "9f86d081884c7d65"]
    assert max(map(bits, weak)) < 30 < secrets.MIN_BITS < min(map(bits, strong))

    def brute(v):  # the cheapest segmentation by words and single signs only is never cheaper
        best = [0.0]
        for j in range(1, len(v) + 1):
            options = [best[j - 1] + secrets._sign_bits(v[j - 1])]
            options += [best[i] + words[v[i:j]] + 1 for i in range(j) if v[i:j] in words]
            best.append(min(options))
        return best[-1] + 1

    for v in ["correcthorse", "xkcdpass", "thedogran"]:
        assert bits(v) <= brute(v) + 1


def test_redaction_takes_effect():
    text = "a password = 'x9Qe7#kLm2Vb' b token: abcdefgh c"
    out = secrets.redacted(text, default_tokenizer())
    assert "x9Qe" not in out and "abcdefgh" not in out and out.startswith("a ") and out.endswith(" c") and secrets.redacted("nothing here", default_tokenizer()) == "nothing here"


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(planted, words, percent):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for r in planted.collect():
        w = WORD.findall(r["text"].translate(lower))
        sets[r["doc_id"]] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(planted, words, percent).collect()}
    assert {i: got[i]["component_id"] for i in sets} == {i: root(i) for i in sets}
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (root(i) == i) for i in sets)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (101, 100)] + [(200, 300 + i) for i in range(50)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[103] == 100 and got[349] == 200


def test_registers_estimate_likeness():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for shared, size in ((1000, 1000), (900, 1000), (0, 1000), (9, 10)):
        a, b = pool[:size], np.concatenate([pool[:shared], pool[2000 : 2000 + size - shared]])
        found = [np.frombuffer(neardup.registers(x), "<u2")[None] for x in (a, b)]
        want = shared / (2 * size - shared)
        assert abs(neardup.estimate(*found, np.array([size]), np.array([size]))[0] - want) < 0.11


def test_substrings(planted, documents):
    for df in (planted, documents):
        seen, got = set(), {r["doc_id"]: r for r in substrings.deduplicated_words(df).collect()}
        for i, text in sorted((r["doc_id"], r["text"]) for r in df.collect()):
            words = WORD.findall(text)
            gone = [False] * len(words)
            for k in range(len(words) - 19):
                window = tuple(words[k : k + 20])
                if window in seen:
                    gone[k : k + 20] = [True] * 20
                seen.add(window)
            kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_spans_name_their_source(planted):
    texts = {r["doc_id"]: WORD.findall(r["text"]) for r in planted.collect()}
    windows = Counter(tuple(w[k : k + 20]) for w in {tuple(w) for w in texts.values()} for k in range(len(w) - 19))
    found = substrings.repeated_spans(planted).collect()
    assert found
    for r in found:
        run = texts[r["doc_id"]][r["from"] : r["to"]]
        assert all(windows[tuple(run[k : k + 20])] == r["occurrences"] for k in range(len(run) - 19))


def test_language_forward_sums_all_segmentations():
    pieces = langid.Lattice(langid.default_vocabulary())
    vocabulary = {}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.default_vocabulary())
    kept = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if p == "▁" or (p.removeprefix("▁").isalpha() and p == p.lower())]
    vocabulary = {p: i for i, p in enumerate(kept)}
    draw = np.random.default_rng(2)
    table = draw.random((pieces.none + 1, 2))
    table[pieces.none] = 0

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, len(word) + 1):
            at = vocabulary.get(word[:k], pieces.unknown if k == 1 else None)
            out += table[at, lang] * total(word[k:], lang) if at is not None else 0
        return out

    words = ["▁the", "▁heit", "▁ñandu", "▁x", "▁日本"]
    got = pieces.log_probabilities(words, table)
    assert np.allclose(got, [[math.log(total(w, k)) for k in (0, 1)] for w in words])
    spread = pieces.expected(words, np.zeros(5, int), np.ones(5), table)
    signs = np.zeros(pieces.none + 1)
    signs[: len(kept)] = [len(p) for p in kept]
    signs[pieces.unknown] = 1
    assert (spread[:, 0] * signs).sum() == pytest.approx(sum(map(len, words)))  # every segmentation covers its word


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98


def test_ids_are_the_tokenizers(texts):
    encoder, own = Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    every = [*texts.values(), *ODD, *(a + b for a in ODD for b in ODD), *(a + " " + b for a in ODD for b in ODD)]
    want = [np.array(x.ids, "<u2").tobytes() for x in own.encode_batch(every, add_special_tokens=False)]
    assert list(encoder.stream(pa.array(every))) == want


def test_records_round_trip(spark, documents, texts, tmp_path):
    path = records.write_records(documents, f"{tmp_path}/out", bytes_of_text=100_000)
    own = Tokenizer.from_file(default_tokenizer())
    want = {i: own.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    index = spark.read.parquet(f"{path}/index")
    at = 0
    for r in sorted(index.collect(), key=lambda r: r["doc_id"]):
        assert (r["start"], r["n_tokens"]) == (at, len(want[r["doc_id"]]))
        at += r["n_tokens"]
    assert index.select("shard").distinct().count() > 1
    some = index.where("doc_id % 7 = 3")
    assert {r["doc_id"]: r["ids"] for r in records.read_by_index(spark, path, some).collect()} == {i: x for i, x in want.items() if i % 7 == 3}
    got = {r["doc_id"]: r["ids_crc32"] for r in records.scan_records(spark, path).collect()}
    assert got == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}


def test_damaged_records_are_found():
    good = records.frame(records.payload(None, np.array([5, 6], "<u2").tobytes(), 2)) + b"\n"
    doc, ids, end = records.parse(good)
    assert doc is None and ids.tolist() == [5, 6] and end == len(good)
    for k in (0, 9, 14, len(good) - 3):
        with pytest.raises(ValueError):
            records.parse(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
    with pytest.raises(ValueError):
        records.parse(good[:-4])


def check_packed(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= x]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_packing(documents, texts):
    rows = packing.pack_documents(documents).collect()
    own = Tokenizer.from_file(default_tokenizer())
    by = defaultdict(dict)
    for r in rows:
        by[r["doc_id"]][r["piece"]] = r
    for i, t in texts.items():
        ids = np.array(own.encode(t, add_special_tokens=False).ids + [0], "<u4")
        cuts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(by[i][k]["start"], by[i][k]["length"], by[i][k]["ids_crc32"]) for k in range(len(by[i]))] == [(2048 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)]
    assert check_packed(rows, 2048) <= best_fit([r["length"] for r in rows], 2048)


def test_packing_plans():
    draw = random.Random(4)
    for capacity, top, n in ((100, 100, 500), (100, 40, 300), (64, 33, 400), (10, 10, 50)):
        lengths = [draw.randint(1, top) for _ in range(n)]
        steps = packing.plan(Counter(lengths), capacity)
        rows, used = [], Counter()
        for length, first, times, sequence, offset in steps:
            assert used[length] == first
            used[length] += times
            rows += [{"sequence_id": sequence + k, "offset": offset, "length": length} for k in range(times)]
        assert used == Counter(lengths) and check_packed(rows, capacity) <= best_fit(lengths, capacity) + 1
    assert [s[0] for s in packing.plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)][:3] == [60, 21, 19]  # 30 gives way to 21 and 19


def test_packed_sequences_hold_the_ids(documents, texts):
    rows = packing.packed_sequences(documents).collect()
    own = Tokenizer.from_file(default_tokenizer())
    assert Counter(x for r in rows for x in r["ids"]) == Counter(x for t in texts.values() for x in [*own.encode(t, add_special_tokens=False).ids, 0])
    assert max(len(r["ids"]) for r in rows) <= 2048


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf)
    kept = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    apart = corpus_pipeline.drop_near_duplicates(spark, good, sf)
    assert {r["doc_id"] for r in apart.collect()} == {r["doc_id"] for r in neardup.near_duplicates(good).where("kept").collect()}
    clean = corpus_pipeline.redact_secrets(spark, apart, sf)
    assert not any(secrets.find(r["text"], default_tokenizer()) for r in clean.collect()) and all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_to_weights(spark, clean, sf).collect())
    want = {r["doc_id"]: sum(2 * x >= max(r["size"], 1) for x in r["takes"]) for r in mixing.mix(mixing.word_sizes(clean)).collect()}
    assert mixed == Counter({i: n for i, n in want.items() if n})
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == mixed
    check_packed(rows, 2048)


def test_contexts_with_blanks_and_letters_only():
    path = default_tokenizer()
    kinds = lambda t: [t[a:b] for a, k, b in secrets.find(t, path) if k == 3]
    assert kinds("Authorization: Bearer x9Qe7kLm2VbT4w") == ["x9Qe7kLm2VbT4w"]
    assert kinds("token: Bearer x9Qe7kLm2VbT4w") == ["x9Qe7kLm2VbT4w"]
    assert kinds("the api key: x9Qe7kLm2VbT4w") == ["x9Qe7kLm2VbT4w"]
    assert kinds("the password is qzxvkwjhplmtrd") == ["qzxvkwjhplmtrd"]
    for prose in ("the password is wonderful", "the bearer certificate", "the secret is überraschungsmoment", "a token is required here"):
        assert kinds(prose) == []


def test_signs_that_are_no_letters_are_no_words():
    assert langid.words_of("½ ² ① Ⅷ") == []
    assert langid.words_of("Größe ½x² — 一二") == ["größe", "x", "一二"]


@pytest.mark.parametrize("percent", [80, 85])
def test_no_pair_at_the_threshold_is_cut_by_its_estimate(percent):
    """10,000 pairs exactly at the threshold, by both kinds of registers."""
    rng, t = np.random.default_rng(percent), percent / 100
    for registers, chance in ((neardup.REGISTERS, 0.17 / 1024), (neardup.FINE, 1 / 256)):
        agree = rng.binomial(registers, t + (1 - t) * chance, 10_000) / registers
        assert ((agree - chance) / (1 - chance) >= t - neardup.margin(t, registers, chance)).all()
    union, both = 200, 2 * percent
    cut = t - neardup.margin(t, neardup.REGISTERS, 0.17 / 1024)
    for _ in range(150):
        found = rng.integers(0, 1 << 64, union, dtype=np.uint64)
        rest = (union - both) // 2
        a, b = found[: both + rest], np.concatenate([found[:both], found[both + rest :]])
        x, y = (np.frombuffer(neardup.registers(v), "<u2")[None] for v in (a, b))
        assert neardup.estimate(x, y, np.array([len(a)]), np.array([len(b)]))[0] >= cut
