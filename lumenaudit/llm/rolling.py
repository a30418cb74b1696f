"""Words of many texts at once, and rolling hashes over words and bytes, in numpy.

Hashes are polynomials modulo 2**64 over a seeded byte substitution.  They
name strings; wherever a result depends on equality, the caller compares the
strings themselves or uses 128 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEEDED = np.random.default_rng(20240607)
_BYTE, _OTHER_BYTE = (_SEEDED.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2))

#: Lower-cased word bytes: digits, letters and everything beyond ASCII.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x30:0x3A] = np.arange(0x30, 0x3A)
LETTERS[0x61:0x7B] = LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)

#: Everything but ASCII white space, A-Z lower-cased.
SOLID = np.arange(256).astype(np.uint8)
SOLID[0x41:0x5B] += 32
SOLID[[0x20, *range(0x09, 0x0E)]] = 0
SOLID[0] = 0xFF  # NUL is a word byte there; 0 marks separators and 0xFF stands in no UTF-8


class _Powers:
    """Powers of the base and of its inverse, as far as needed; travels to tasks empty."""

    def __init__(self):
        self.have = {1: np.ones(1, U), -1: np.ones(1, U)}

    def __reduce__(self):
        return _Powers, ()

    def __call__(self, n: int, sign: int = 1) -> np.ndarray:
        """Powers 0..n-1."""
        if len(self.have[sign]) < n:
            grown = np.full(n + (n >> 2), _BASE if sign == 1 else pow(_BASE, -1, 2**64), U)
            grown[0] = 1
            self.have[sign] = np.cumprod(grown)
        return self.have[sign][:n]


powers = _Powers()


def prefix(codes: np.ndarray, other: bool = False) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows; ``other`` substitutes bytes by another table."""
    out = np.empty(len(codes) + 1, U)
    out[0] = 0
    np.cumsum((_OTHER_BYTE if other else _BYTE)[codes] * powers(len(codes)), out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same wherever it stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), -1)[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits (finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """The words of several texts: byte ranges, text of each, and offsets."""

    def __init__(self, texts: list[bytes], classes: np.ndarray = LETTERS):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.codes = classes[raw]
        inside = self.codes != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([np.zeros(1, edge.dtype), edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.text_start = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        self.first = np.searchsorted(self.starts, self.text_start)  # of each text, and the end
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.position = np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = ranges(prefix(self.codes), self.starts, self.ends)
        return self._hashes

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of first words of all k-word runs within one text, and their hashes."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, U)
        h = self.hashes
        total = h[:n].copy()
        for i in range(1, k):
            total = total * U(_BASE) + h[i : n + i]
        at = np.flatnonzero(self.position[:n] + k <= self.counts[self.owner[:n]])
        return at, mix(total[at] + U(k))

    def strings(self, a: int, b: int) -> list[bytes]:
        """Words a..b-1."""
        view = self.codes.tobytes() if b - a > 1000 else None
        if view is None:
            return [self.codes[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b])]
        return [view[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]
