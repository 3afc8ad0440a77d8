"""Vectorised hashes, seeds and places against plain versions."""

import numpy as np

from duewise.llm import quality, shingles, substrings
from duewise.llm.shingles import text_hashes


def test_words_of_grouped_texts_have_equal_hashes_only_if_equal(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"ab\x00\xc3\xa9\xa0\x1c"), n).tolist()) for n in rng.integers(1, 70, 300)]
    words += [b"a" * n for n in range(1, 70)] + [b"a" * n + b"\x00" for n in range(1, 70)]
    texts = [b"", b" \n"]
    for _ in range(200):
        n = rng.integers(0, 40)
        texts.append(b"".join(words[i] + bytes([b]) for i, b in zip(rng.integers(0, len(words), n), rng.choice([9, 10, 11, 12, 13, 32], n), strict=True)))
    seen = {}
    for together in (1, 500, 1 << 18):
        monkeypatch.setattr(shingles, "TOGETHER", together)
        found = list(text_hashes(texts))
        assert [len(f) for f in found] == [len(t.split()) for t in texts]
        for hashes, text in zip(found, texts, strict=True):
            for value, word in zip(hashes.tolist(), text.split(), strict=True):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen) and list(text_hashes([])) == []


def test_seeds_are_the_first_least_runs_of_windows():
    rng = np.random.default_rng(6)
    for n, window, seed in [(200, 20, 6), (20, 20, 6), (60, 9, 3), (50, 8, 8), (50, 7, 6)]:
        runs, at = substrings.seeds(rng.integers(0, 3, n).astype(np.uint64), window, seed)
        wide = np.lib.stride_tricks.sliding_window_view(runs, window - seed + 1)
        assert at.tolist() == (wide.argmin(axis=1) + np.arange(len(wide))).tolist()


def test_distinct_runs_and_places_with_crowded_slots(monkeypatch):
    rng = np.random.default_rng(7)
    for slots in (2, 20):
        monkeypatch.setattr(quality, "_SLOTS", slots)
        monkeypatch.setattr(quality, "_PIECE", 50)
        pieces = [rng.integers(0, 1 << 48 if i % 3 else 40, 60) for i in range(30)]
        known = quality.distinct_runs(iter(pieces))
        assert known.tolist() == sorted({v for piece in pieces for v in piece.tolist()})
        assert all((known[quality.Places(known).of(piece)] == piece).all() for piece in pieces)
    assert len(quality.distinct_runs(iter(()))) == 0


def test_runs_fold_signs_beyond_the_first_plane():
    signs = [_sign(c) for c in "a 7€\U0001f600 b"]
    padded = [1, 1, 1, *signs]
    want = [sum(s << quality.BITS * (3 - j) for j, s in enumerate(padded[i : i + 4])) for i in range(len(signs))]
    assert quality.runs(" a\t7€\U0001f600\n\nb ", 4).tolist() == want and len(quality.runs(" \n", 4)) == 0


def _sign(char: str) -> int:
    half = 1 << quality.BITS - 1
    return ord("0") if char.isdigit() else ord(char) if ord(char) < 2 * half else half + ord(char) % half
