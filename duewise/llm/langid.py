"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. A word, lower-cased and with a mark at its front, is
cut into pieces in every possible way; its probability is the sum over all segmentations of the product of its pieces, which
a forward pass gets in one sweep. A text's score is the sum of its words' log probabilities and the language's prior.

Training is expectation maximisation over the labelled texts: Spark counts words by language, each pass distributes a word's
count over its segmentations (forward and backward) and Spark adds up the pieces. All labelled words count. What goes to the
driver and is broadcast is one number for each piece and language, so its size is fixed by the vocabulary and the languages.
Scoring keeps the words that a Python worker has seen, up to ``KEPT`` of them.

A word is a run of letters. Runs over ``LONGEST`` letters are scored as stretches of that many, which keeps products in range.
A letter that is no piece by itself counts as the unknown piece.

Cases. Null texts and texts without a letter are ``und`` with score 0, as all are if nothing was learned. Null labels are not
learned from. Ties go to the language that sorts first. Repeated rows, null ids and other columns do not matter. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import materialise

PASSES = 3
ADDED = 0.05
LONGEST = 32
KEPT = 300_000
FRONT = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


class Lattice:
    """The pieces of a vocabulary that can stand in a lower-case word, and what they make of words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        kept = [p for p in pieces if p == FRONT or (p.removeprefix(FRONT).isalpha() and p == p.lower())]
        self.longest = max(map(len, kept))
        self.unknown, self.none = len(kept), len(kept) + 1
        hashes = np.array([int(self._hash(_signs([p]))[-1][0]) for p in kept], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    @staticmethod
    def _hash(signs: np.ndarray) -> list[np.ndarray]:
        """Of each row's first 1, 2, ... signs."""
        out, h = [], np.zeros(len(signs), np.uint64)
        for k in range(signs.shape[1]):
            h = (h + signs[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            out.append(h)
        return out

    def edges(self, words: list[str]):
        """For words of one length: (from, to, each word's piece between)."""
        signs = _signs(words)
        size = signs.shape[1]
        for i in range(size):
            for j, h in enumerate(self._hash(signs[:, i : i + self.longest]), i + 1):
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                found = self.sorted[at] == h
                if j == i + 1 or found.any():
                    yield i, j, np.where(found, self.order[at], self.unknown if j == i + 1 else self.none)

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Of each word (rows) in each language (columns). ``table``: pieces, the unknown piece and a row of zeros, by language."""
        out = np.empty((len(words), table.shape[1]))
        for places in by_length(words):
            group = [words[k] for k in places]
            alpha = np.zeros((len(group[0]) + 1, len(group), table.shape[1]))
            alpha[0] = 1
            for i, j, ids in self.edges(group):
                alpha[j] += alpha[i] * table[ids]
            out[places] = np.log(alpha[-1])
        return out

    def expected(self, words: list[str], language: np.ndarray, count: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected pieces by language over all segmentations of each word in its language."""
        out = np.zeros(table.shape)
        for places in by_length(words):
            group, own = [words[k] for k in places], language[places]
            size = len(group[0])
            edges = list(self.edges(group))
            alpha, beta = np.zeros((size + 1, len(group))), np.zeros((size + 1, len(group)))
            alpha[0] = beta[size] = 1
            for i, j, ids in edges:
                alpha[j] += alpha[i] * table[ids, own]
            for i, j, ids in sorted(edges, key=lambda e: -e[0]):
                beta[i] += beta[j] * table[ids, own]
            each = count[places] / alpha[size]
            for i, j, ids in edges:
                np.add.at(out, (ids, own), alpha[i] * table[ids, own] * beta[j] * each)
        return out


def _signs(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


def by_length(words: list[str]):
    places = defaultdict(list)
    for k, w in enumerate(words):
        places[len(w)].append(k)
    return places.values()


def words_of(text: str) -> list[str]:
    """Lower-case words with the mark at their front, long ones in stretches."""
    found = LETTERS.findall(text.lower())
    if not text.isascii() and found and not "".join(found).isalpha():  # signs like ½, ² and Ⅷ count as numbers
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all labelled texts, added up in each batch before the shuffle."""

    def count(batches):
        for batch in batches:
            counts = defaultdict(Counter)
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(words_of(text.as_py()))
            for lang, words in counts.items():
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return labelled.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Probabilities of the pieces by language, and the languages' log priors."""

    def __init__(self, languages: list[str], table: np.ndarray, prior: np.ndarray, vocabulary: str):
        self.languages, self.table, self.prior, self.vocabulary = languages, table, prior, vocabulary


def train(docs: DataFrame, vocabulary: str | None = None, passes: int = PASSES, added: float = ADDED) -> Model:
    """Learn from text and lang of all given rows."""
    path = vocabulary or default_vocabulary()
    pieces = lattice(path)
    counts = materialise(word_counts(docs), "word-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    languages = sorted(totals)
    prior = np.log(np.array([totals[x] for x in languages], float) / max(1, sum(totals.values())))
    table = np.full((pieces.none + 1, len(languages)), 1 / (pieces.unknown + 1))
    table[pieces.none] = 0
    if not languages:
        return Model([], table, prior, path)
    place = {x: k for k, x in enumerate(languages)}
    spark = docs.sparkSession
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(table)

        def expect(batches, sent=sent):
            made = np.zeros(sent.value.shape)
            for batch in batches:
                words = batch.column(1).to_pylist()
                own = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                words = [FRONT + w for w in words]
                made += lattice(path).expected(words, own, batch.column(2).to_numpy(zero_copy_only=False).astype(float), sent.value)
            piece, lang = np.nonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(made[piece, lang], pa.float64())], ["piece", "lang", "n"])

        found = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got = found.toPandas()  # at most the pieces times the languages
        raw = np.full(table.shape, added)
        raw[got["piece"], got["lang"]] += got["n"]
        raw[pieces.none] = 0
        table = raw / raw.sum(axis=0)
    return Model(languages, table, prior, path)


def identify(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns of every row, with lang_pred and score (the posterior of the language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_text").schema) + ", lang_pred string, score double"

    def run(batches):
        m = sent.value
        pieces, seen = lattice(m.vocabulary), {}
        known = np.empty((0, len(m.languages)))

        def look_up(texts):
            nonlocal known
            cut = [words_of(t) if t else [] for t in texts]
            new = set().union(*cut).difference(seen)
            if len(seen) + len(new) > KEPT:
                seen.clear()
                known, new = known[:0], set().union(*cut)
            if new:
                new = list(new)
                seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
                known = np.vstack([known, pieces.log_probabilities([FRONT + w for w in new], m.table)])
            for words in cut:
                if not words or not m.languages:
                    yield UNDETERMINED, 0.0
                    continue
                at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                total = known[at].sum(axis=0) + m.prior
                best = int(total.argmax())
                yield m.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())

        for batch in batches:
            texts, found, group, signs = batch.column(batch.num_columns - 1), [], [], 0
            for text in texts:
                group.append(text.as_py())
                signs += len(group[-1] or "")
                if signs > 2_000_000:
                    found += look_up(group)
                    group, signs = [], 0
            found += look_up(group)
            langs, scores = zip(*found, strict=True) if found else ((), ())
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def held_out() -> Column:
    """Documents that are not learned from: remainder 2 of the id's crc32 by 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out()), **options)
    return identify(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out")])
