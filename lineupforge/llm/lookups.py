"""Sorted hash arrays and word hashing for models that run inside tasks."""

from __future__ import annotations

import numpy as np

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finisher of splitmix64, a public domain generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Numbered(dict):
    """Numbers words in the order in which they are asked for; new has those since it was last cleared."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return self[word]


class Sorted:
    """Values by 64-bit key in a sorted array; get() has a row of values for each key asked, default where none is."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.default = keys[order], values[order], default

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.find(keys)
        return np.where((at >= 0)[:, None], self.values[at], self.default) if len(self.keys) else np.repeat(self.default[None], len(keys), 0)


_hashed: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word; a worker keeps up to 200,000 words' hashes."""
    import xxhash

    if len(_hashed) > 200_000:
        _hashed.clear()
    try:
        return np.fromiter(map(_hashed.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in _hashed:
                _hashed[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(_hashed.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The hash of each run of size word hashes; another odd factor gives an independent hash."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        out += hashes[j : j + n] * np.uint64(pow(odd, j + 1, 2**64))
    return mixed(out)
