"""Word shingles of whole texts as 64-bit hashes, and one-permutation MinHash signatures, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
# Words: [^\x20\x09-\x0D]+ with A-Z lowered.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _M3)[_LOWER]
_PLACES = mix((np.arange(64, dtype=np.uint64) + np.uint64(501)) * _M3) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more entry: the end)."""
    return words_of(texts)[:2]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes(), and of each word the last two bytes, lowered, as one number (the last alone in a word of one)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    up, down = _powers_to(len(raw))
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * down[starts])
    begins = np.concatenate([[0], np.cumsum(lengths)]) + 1
    low = _LOWER[raw].astype(np.int32)
    tails = np.where(ends - starts > 1, low[ends - 2] << 8, 0) | low[ends - 1]
    return words, np.searchsorted(starts, begins), tails


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Each text's set of shingles, sorted: of `size` words; of all words if there are fewer; empty without words."""
    words, at = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        n = len(words) - size + 1
        full = np.zeros(max(n, 0), np.uint64)
        for j in range(size):
            full += words[j : j + max(n, 0)] * _PLACES[j]
        full = mix(full)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                own = full[a : b - size + 1].copy()
                own.sort()
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                out.append(mix(((words[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a) * _M3).reshape(1)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class OnePermutation:
    """Signatures of `bins` values: each bin's least hash; an empty bin takes that of the first full bin on its own
    pseudo-random walk (optimal densification)."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = ((np.arange(self.bins, dtype=object) << 64) // self.bins).astype(np.uint64)
        self.walks: list[np.ndarray] = []
        self.tags = mix((np.arange(bands, dtype=np.uint64) + np.uint64(77)) * _M3)

    def walk(self, t: int) -> np.ndarray:
        while len(self.walks) <= t:
            seeds = np.arange(self.bins, dtype=np.uint64) + np.uint64(self.bins * (len(self.walks) + 1))
            with np.errstate(over="ignore"):
                self.walks.append((mix(seeds * _M3) % np.uint64(self.bins)).astype(np.int64))
        return self.walks[t]

    def signature(self, own: np.ndarray) -> np.ndarray:
        """The values of a non-empty sorted set."""
        if len(own) == 1:
            return np.full(self.bins, own[0])
        first = np.searchsorted(own, self.edges)
        full = np.diff(np.append(first, len(own))) > 0
        values = own[np.minimum(first, len(own) - 1)]
        open_bins, t = np.flatnonzero(~full), 0
        while len(open_bins):
            if t == 4096:  # sets of two or three: what few bins are left take the first full one
                values[open_bins] = own[0]
                break
            to = self.walk(t)[open_bins]
            hit = full[to]
            values[open_bins[hit]] = values[to[hit]]
            open_bins = open_bins[~hit]
            t += 1
        return values

    def keys_of(self, values: np.ndarray) -> np.ndarray:
        """One bucket key a band of a signature."""
        rows = mix(values.reshape(self.bands, self.rows))
        with np.errstate(over="ignore"):
            return mix((rows * _PLACES[: self.rows]).sum(1) + self.tags)


def set_hash(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = mix(own ^ _M2).sum(dtype=np.uint64) + np.uint64(len(own)) * _M3
        b = np.bitwise_xor.reduce(mix(own * _M3 + _M1)) if len(own) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
