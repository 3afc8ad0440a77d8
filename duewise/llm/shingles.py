"""Word and shingle hashes of UTF-8 texts, vectorised inside a task."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = bytes(b in b"\t\n\v\f\r " for b in range(256))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of the longest word that is hashed together with others.
LONG = 32
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 18
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def text_hashes(texts):
    """The hashes of each text's words, as many texts at a time as make ``TOGETHER`` bytes."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text) + 1
        if held >= TOGETHER:
            yield from _group_hashes(group)
            group, held = [], 0
    yield from _group_hashes(group)


def _group_hashes(group: list[bytes]):
    if group:
        hashes, starts = _hashes(b" ".join(group))
        ends = np.cumsum([len(text) + 1 for text in group])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))


def _hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the place of every word: eight bytes of all words at a time, longer words than ``LONG`` one by one."""
    blank = np.frombuffer(b"\x01" + text.translate(_BLANK) + b"\x01", np.uint8)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    eights = np.ndarray(len(text) + LONG - 7, "<u8", text + bytes(LONG), 0, (1,))  # those that begin at each byte
    out = mixed(lengths.astype(np.uint64))
    out = mixed(out ^ (eights[starts] & _FIRST[np.minimum(lengths, 8)]))
    for k in range(8, min(LONG, lengths.max(initial=0)), 8):
        at = np.flatnonzero(lengths > k)
        out[at] = mixed(out[at] ^ (eights[starts[at] + k] & _FIRST[np.minimum(lengths[at] - k, 8)]))
    for i in np.flatnonzero(lengths > LONG) if lengths.max(initial=0) > LONG else ():
        out[i] = xxh64_intdigest(text[starts[i] : ends[i]])
    return out, starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """One hash for each run of ``words`` words, in order; fewer words make one shingle, none make none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(words, n)
    out = np.full(n - size + 1, np.uint64(size))
    for j in range(size):
        out = out * _STEP + hashes[j : n - size + 1 + j]
    return mixed(out)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Ascending distinct shingle hashes of a text: A to Z lower-cased, words parted by blanks and the five ASCII controls."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), words))
