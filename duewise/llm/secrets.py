"""Secret scan: fixed patterns, and the guess cost of values in a credential context.

Base kinds, leftmost and non-overlapping each: ``assign`` (a credential's name, a sign, a value of 6 or more), ``access`` (an
access key id of 20 or more), ``hex`` (a run of 24 or more hex digits). The kind ``guess`` is added by the method: a value
that follows a wider set of credential names is a secret if the cheapest way to guess it costs ``MIN_BITS`` or more. The cost is
a dynamic program over positions: the cheapest segmentation into dictionary words, dates, repeats, sequences, keyboard walks
and brute-force spans. So ``pwd: summer2024`` is no secret and ``pwd: x9Qe7#kLm2Vb`` is one, and ``the password is wonderful``
is prose while random letters in its place are not. A name may be followed by a sign or ``is``, and ``Bearer`` by its value at
once; words of letters beyond ASCII after these two are taken for prose.

The dictionary is a public tokenizer's vocabulary in its order of merging, which stands for frequency. Costs are bounded by
value length times a constant.

Cases. Null texts count as empty. Empty texts have no spans. Offsets count code points. Every row is scanned on its own, so
repeated rows, null ids and other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import give_back
from duewise.llm.tokens import default_tokenizer

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 33.0
PLACEHOLDER = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as runs of any length, less those that are too short
_CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[\x20_-]?key|bearer)["']?[\x20\t]*([:=]+>?|\bis\b)|\bbearer(?=[\x20\t]))[\x20\t]*["'`]?(?:bearer[\x20\t]+)?([^\s"'`,;<>()\[\]{}]{6,})""",
    re.ASCII | re.IGNORECASE,
)
SCAN = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"

# Rows of a keyboard, each with the horizontal shift of its first key in quarter keys.
_ROWS = (("`1234567890-=", 0), ("qwertyuiop[]\\", 6), ("asdfghjkl;'", 7), ("zxcvbnm,./", 9))
_SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
_PLACE = {key: (row, shift + 4 * i) for row, (keys, shift) in enumerate(_ROWS) for i, key in enumerate(keys)}
_LEET = str.maketrans("43105$@7", "aeiosast")
_DATE = re.compile(
    r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)"
)
_LONGEST_WORD, _LONGEST_WALK, _LONGEST_PERIOD = 20, 24, 8


@lru_cache(maxsize=1)
def dictionary(path: str) -> dict[str, float]:
    """Bits of each word: the logarithm of its rank in the vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and len(w) > 6 and w[:-4].isascii() and w[:-4].isalpha())
    return {w: math.log2(rank + 2) for rank, (_, w) in enumerate(words)}


def _sign_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isalpha() and c.isascii():
        return math.log2(26)
    return math.log2(33) if c.isascii() else math.log2(100)


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbouring one."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if not p or not q:
        return None
    down, along = q[0] - p[0], q[1] - p[1]
    near = (down == 0 and abs(along) == 4) or (abs(down) == 1 and abs(along) <= 3)
    return (down, (along > 0) - (along < 0)) if near else None


def guess_bits(value: str, words: dict[str, float]) -> float:
    """Bits of the cheapest segmentation. A segment costs its own bits and one for the choice of its kind."""
    n = len(value)
    low = value.lower()
    leet, keys = low.translate(_LEET), low.translate(_SHIFTED)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # at each end: (start, bits)
    for m in (m for i in range(n) if value[i].isdigit() for m in [_DATE.match(value, i)] if m):
        long = m.end() - m.start() > 4
        ends[m.end()].append((m.start(), math.log2(365.25 * 130) if long else math.log2(130)))
    run_steps, directions, sequence = 0, [], 0
    matching = [0] * (_LONGEST_PERIOD + 1)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _sign_bits(c))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        options = [best[i] + bits for i, bits in ends[j]]
        for i in range(max(0, j - _LONGEST_WORD), j - 2):
            for text, extra in ((low, 0.0), (leet, 2.0)):
                bits = words.get(text[i:j])
                if bits is not None:
                    upper = sum(map(str.isupper, value[i:j]))
                    case = 0.0 if not upper else 1.0 if upper == j - i or (upper == 1 and value[i].isupper()) else float(j - i)
                    options.append(best[i] + bits + extra + case)
                    break
        if j > 1:
            step = _step(keys[j - 2], keys[j - 1])
            run_steps = run_steps + 1 if step else 0
            directions.append(step)
            turns = 0
            for length in range(2, min(run_steps, _LONGEST_WALK) + 2):
                if length > 2 and directions[j - length] != directions[j - length + 1]:
                    turns += 1
                if length >= 3:
                    options.append(best[j - length] + math.log2(len(_PLACE)) + math.log2(length) + turns * math.log2(6))
            rise = ord(value[j - 1]) - ord(value[j - 2])
            same = abs(rise) == 1 and value[j - 1].isalnum() and value[j - 2].isalnum()
            sequence = (sequence + rise if sequence * rise > 0 else rise) if same else 0
            if abs(sequence) >= 2:
                options.append(best[j - abs(sequence) - 1] + 1 + _sign_bits(value[j - 1]) + math.log2(abs(sequence) + 1))
        for period in range(1, min(_LONGEST_PERIOD, j - 1) + 1):
            matching[period] = matching[period] + 1 if value[j - 1] == value[j - 1 - period] else 0
            times = matching[period] // period + 1
            if times >= (3 if period == 1 else 2):
                start = j - times * period
                options.append(best[start] + brute[start + period] - brute[start] + math.log2(times))
        options.append(best[j - 1] + _sign_bits(value[j - 1]) - 1)  # goes on with brute force
        best[j] = min(options) + 1
    return best[n]


def find(text: str | None, words_path: str, min_bits: float = MIN_BITS) -> list[tuple[int, int, int]]:
    """All spans as (start, index of the kind, end), in order."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _CONTEXT.finditer(text):
        if (m[1] or "is").lower() == "is" and m[2].isalpha() and not m[2].isascii():  # prose that the dictionary does not know
            continue
        if guess_bits(m[2], dictionary(words_path)) >= min_bits:
            spans.append((m.start(2), 3, m.end(2)))
    return sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, words_path: str | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id, counts by kind, base_sha256 over the base kinds' spans, spans of all kinds."""
    path = words_path or default_tokenizer()
    names = [x.split()[0] for x in SCAN.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = find(text.as_py(), path, min_bits)
                base = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)


def redacted(text: str | None, words_path: str, min_bits: float = MIN_BITS) -> str | None:
    """The text with every span, overlapping ones together, replaced by a placeholder."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in find(text, words_path, min_bits):
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, words_path: str | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced; ``n_chars``, if there is one, follows a changed text."""
    path = words_path or default_tokenizer()

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((redacted(t.as_py(), path, min_bits) for t in texts), pa.string(), size=len(texts))
        give_back()

    done = docs.withColumn("_clean", clean(F.col("text").cast("string")))
    length = lambda kind: F.when(F.col("_clean").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("_clean")).cast(kind)
    out = []
    for f in docs.schema.fields:
        if f.name == "text":
            out.append(F.col("_clean").alias("text"))
        else:
            out.append(length(f.dataType).alias("n_chars") if f.name == "n_chars" else F.col(f"`{f.name}`"))
    return done.select(*out)
