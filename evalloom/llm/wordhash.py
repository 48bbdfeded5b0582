"""Hashes of words and of runs of words, over the concatenated words of many texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import WORD

_WORD = re.compile(WORD)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """``code`` (64 bits a word), ``doc`` and ``pos`` of every word; ``n`` words of each text, from ``start``."""

    def __init__(self, texts: list[str | None], pattern: re.Pattern = _WORD):
        words = [pattern.findall(t) if t else [] for t in texts]
        ids = dict.fromkeys(w for own in words for w in own)
        ids = dict(zip(ids, range(len(ids)), strict=True))
        self.n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.fromiter((ids[w] for own in words for w in own), dtype=np.int64, count=int(self.n.sum()))
        codes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids), dtype=np.uint64, count=len(ids))
        self.code = codes[at]
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(words)), self.n)
        self.pos = np.arange(len(at)) - self.start[self.doc]

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of ``size`` words; a text of fewer words, but not none, is one run."""
        length = np.minimum(self.n, size)
        h = np.zeros(len(self.code), dtype=np.uint64)
        room = self.n[self.doc] - self.pos
        for j in range(size):
            ok = room > j
            h[ok] = h[ok] * _BASE + self.code[np.flatnonzero(ok) + j]
        full = room >= length[self.doc]
        return self.doc[full], mix(h[full] * _MIX + length[self.doc[full]].astype(np.uint64))

    def whole(self) -> np.ndarray:
        """Hash of each text's sequence of words."""
        place = mix(self.pos.astype(np.uint64) + _BASE)
        sums = np.zeros(len(self.n) + 1, dtype=np.uint64)
        if len(self.code):
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(self.code ^ place), dtype=np.uint64)])
            sums = total[self.start]
        return mix((sums[1:] - sums[:-1]) ^ mix(self.n.astype(np.uint64)))
