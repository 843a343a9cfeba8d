"""Hashes of words and of five-word shingles of many texts at once, with numpy."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (runs of other than ASCII white space), and the text it is of."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(1 << max(22, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    code = (sums[end] - sums[start]) * inverse[start]
    code ^= code >> np.uint64(32)
    code *= _MIX
    code ^= code >> np.uint64(29)
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    return code, np.searchsorted(first, start, side="right") - 1


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct five-word shingles of every text; a text of one to four words is one shingle."""
    code, owner = word_hashes(texts)
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not len(code):
        return out
    counts = np.bincount(owner, minlength=len(texts))
    size = max(0, len(code) - WORDS + 1)
    gram = code[:size].copy()
    for k in range(1, WORDS):
        gram *= _BASE
        gram += code[k : size + k]
        gram ^= gram >> np.uint64(31)
    gram *= _MIX
    gram ^= gram >> np.uint64(33)
    keep = owner[:size] == owner[WORDS - 1 :] if size else np.zeros(0, bool)
    gram, of = gram[keep], owner[:size][keep]
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    fresh = np.ones(len(gram), dtype=bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    gram, of = gram[fresh], of[fresh]
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    for i in np.flatnonzero(counts >= WORDS):
        out[i] = gram[ends[i] : ends[i + 1]]
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        out[i] = np.frombuffer(blake2b(code[owner == i].tobytes(), digest_size=8).digest(), dtype=np.uint64)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles apart."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()
