"""Token ids of whole texts with a public tokenizer file, exact and without encoding the same word twice.

The tokenizer splits at white space and between letters and other signs, and lower-cases sign by sign. So the ids of a
text are the ids of its parts in a row, cut between letters, digits and other signs, and a Python worker keeps the ids of parts it
has used lately. A word is one part if it holds a sign from U+0250 on, an apostrophe (which joins with the letters after it) or
``<|`` (which may begin a special token).
``tests/llm`` holds the result against the tokenizer's own over all test texts and odd ones.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np

from duewise.llm.common import give_back

#: Parts of one generation that a Python worker keeps; it holds two, some 60 MB. This bounds memory, not results.
KEPT = 200_000
#: New parts that are encoded in one call, with a blank between them.
TOGETHER = 400
#: Signs that are cut at once, and the longest part known by its hash.
SIGNS, LONGEST = 500_000, 64

_BY_SPACE = re.compile("[^\x20\x09-\x0d]+")
_BEYOND = re.compile("[^\x00-\u024f]")
_ODD = re.compile("[^\x00-\u024f]|[\u0130\u023a\u023e]")  # the last three have signs beyond in lower case
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind and random value of the signs below U+0250; powers of an odd number and of its inverse, modulo 2^64."""
    kinds = np.full(0x250, _OTHER, np.uint8)
    for sign in range(0x250):
        text = chr(sign)
        kinds[sign] = _SPACE if 9 <= sign <= 13 or sign in (0x20, 0x85, 0xA0) else _LETTER if text.isalpha() else _DIGIT if text.isdecimal() else _OTHER
        if kinds[sign] == _OTHER and text != "_" and re.match(r"\w", text):
            kinds[sign] = _LETTER if not text.isdigit() else _DIGIT
    values = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 0x250, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    powers = [np.full(2 * SIGNS + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for x in powers:
        x[0] = 1
        np.cumprod(x, out=x)
    return kinds, values, *powers


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to little-endian ids: 16 bits each where the vocabulary allows it, else 32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.parts: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith("</w>")

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each of some different parts."""
        out: list[bytes] = [b""] * len(parts)
        plain = [i for i, x in enumerate(parts) if x.isalpha()]
        single = [i for i, x in enumerate(parts) if not x.isalpha()]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        width = self.dtype.itemsize
        for group, ids in zip(groups, self._encoded([" ".join([parts[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            if len(ends) == len(group):
                raw, start = ids.tobytes(), 0
                for i, end in zip(group, ends, strict=True):
                    out[i] = raw[start:end]
                    start = end
            else:
                single += group
        for i, ids in zip(single, self._encoded([parts[i] for i in single]), strict=True):
            out[i] = np.array(ids, self.dtype).tobytes()
        return out

    def _known(self, keys: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of different parts by their keys; parts that a generation has used stay for the next."""
        if len(self.parts) > KEPT:
            self.older, self.parts = self.parts, {}
        parts, older, keys = self.parts, self.older, keys.tolist()
        new = [i for i, key in enumerate(keys) if key not in parts]
        if older:
            parts.update([(keys[i], older[keys[i]]) for i in new if keys[i] in older])
            new = [i for i in new if keys[i] not in parts]
        words = [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        parts.update(zip([keys[i] for i in new], self._ids(words), strict=True))
        return list(map(parts.__getitem__, keys))

    def _simple(self, texts: list[str]) -> list[bytes]:
        """Texts of signs below U+0250 without ``<|``: cut by kind and looked up as arrays, equal parts once."""
        kinds, values, powers, back = _tables()
        text = "\n".join(texts)
        signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = kinds[signs]
        cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)])) if len(kind) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(kind))
        part = kind[cut] != _SPACE
        starts, ends = cut[part], ends[part]
        if "'" in text:  # a word with an apostrophe is one part
            blank = np.concatenate([[True], (signs == 0x20) | ((signs >= 9) & (signs <= 13)), [True]])
            word_starts, word_ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
            marks = np.unique(np.searchsorted(word_starts, np.flatnonzero(signs == ord("'")), "right") - 1)
            word_starts, word_ends = word_starts[marks], word_ends[marks]
            at = np.searchsorted(word_starts, starts, "right") - 1
            inside = (at >= 0) & (starts < word_ends[np.maximum(at, 0)])
            starts, ends = np.concatenate([starts[~inside], word_starts]), np.concatenate([ends[~inside], word_ends])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[signs] * powers[: len(signs)])])
        keys = (sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64)
        long = np.flatnonzero(ends - starts > LONGEST)
        names: dict[str, int] = {}  # long parts are told apart by their text
        for i in long.tolist():
            keys[i] = names.setdefault(text[starts[i] : ends[i]], len(names))
        short = np.ones(len(keys), bool)
        short[long] = False
        found, first, which = np.unique(keys[short], return_index=True, return_inverse=True)
        pieces = self._known(found, text, starts[short][first], ends[short][first]) + self._ids(list(names))
        index = np.empty(len(keys), np.int64)
        index[short], index[long] = which, keys[long].astype(np.int64) + len(found)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        ids, before = np.frombuffer(b"".join(pieces), self.dtype), np.cumsum(sizes) - sizes
        counts = sizes[index]
        after = np.concatenate([[0], np.cumsum(counts)])
        out = ids[np.repeat(before[index] - after[:-1], counts) + np.arange(after[-1])]
        stops = after[np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]) - 1)].tolist()
        return [out[a:b].tobytes() for a, b in zip([0, *stops], stops, strict=False)]

    def _odd(self, text: str) -> bytes:
        """Any other text, word by word."""
        words = _BY_SPACE.findall(text)
        plain = [i for i, w in enumerate(words) if len(w) < SIGNS and "<|" not in w and not _BEYOND.search(w)]
        places = np.cumsum([len(words[i]) + 1 for i in plain]) // SIGNS
        out: dict[int, bytes] = {}
        for group in np.split(np.array(plain, np.int64), np.flatnonzero(np.diff(places)) + 1):
            out |= zip(group.tolist(), self._simple([words[i] for i in group.tolist()]), strict=True)
        rest = {w for i, w in enumerate(words) if i not in out}
        ids = dict(zip(rest, self._ids(list(rest)), strict=True))
        return b"".join([out[i] if i in out else ids[w] for i, w in enumerate(words)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        simple, lowered, held = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text or len(text) > SIGNS or not (text.isascii() or not _ODD.search(text)):
                out[i] = self._odd(text)
                continue
            low = text.lower()
            if held + len(low) + 1 > 2 * SIGNS:
                for j, ids in zip(simple, self._simple(lowered), strict=True):
                    out[j] = ids
                simple, lowered, held = [], [], 0
            simple.append(i)
            lowered.append(low)
            held += len(low) + 1
        if simple:
            for j, ids in zip(simple, self._simple(lowered), strict=True):
                out[j] = ids
        return out

    def stream(self, texts, signs: int = SIGNS):
        """``encode`` for many texts (an Arrow column), some signs at a time."""
        group, held = [], 0
        for text in texts:
            text = text.as_py()
            group.append(text)
            held += len(text or "")
            if held >= signs:
                yield from self.encode(group)
                group, held = [], 0
        yield from self.encode(group)


    def forget(self) -> None:
        """Give back what a task has held; the worker may serve other stages next."""
        self.parts, self.older = {}, {}
        _tables.cache_clear()
        give_back()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
