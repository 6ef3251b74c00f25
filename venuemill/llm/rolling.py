"""Array helpers for many texts at once: words, prefix hashes, sliding minima.

All of it works on the texts of one bounded block, laid end to end.  Hashes of ranges are polynomials modulo the
prime 2**61 - 1 over random codes of the symbols; prefix sums give the hash of any range.  (Modulo a power of two
there are texts, such as Thue-Morse words, that collide whatever the base and the codes are.)
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 61) - 1
BASE = 0x1E3779B97F4A7C15 % PRIME
ASCII_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
_P, _LOW31, _LOW30, _LOW32 = (np.uint64(x) for x in (PRIME, (1 << 31) - 1, (1 << 30) - 1, (1 << 32) - 1))
_29, _30, _31, _32, _61 = (np.uint64(x) for x in (29, 30, 31, 32, 61))
#: Numbers multiplied at a time, so that what comes between stays in the processor's cache.
_AT_ONCE = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    out = np.empty(len(a), np.uint64)
    for at in range(0, len(a), _AT_ONCE):
        x, y = a[at : at + _AT_ONCE], b[at : at + _AT_ONCE]
        x_high, x_low, y_high, y_low = x >> _31, x & _LOW31, y >> _31, y & _LOW31
        middle = x_high * y_low + x_low * y_high
        out[at : at + _AT_ONCE] = _reduced(
            ((x_high * y_high) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + x_low * y_low
        )
    return out


def _running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime of numbers below it, by their low 32 and high 29 bits."""
    low, high = np.cumsum(x & _LOW32, dtype=np.uint64), np.cumsum(x >> _32, dtype=np.uint64)
    return _reduced((low & _P) + (high >> _29) + ((high & np.uint64((1 << 29) - 1)) << _32))


def symbol_codes(seed: int, n: int = 256) -> np.ndarray:
    """Random 64-bit codes, the same in every task."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grown(base: int, size: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < size:  # twice as many each time
            out = np.concatenate([out, _product(out, np.full(len(out), pow(base, len(out), PRIME), np.uint64))])
        return out

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._grown(self.base, n), self._grown(self.inverse, n)
        return self.up[:n], self.down[:n]


class PrefixHash:
    """Hashes of ranges of a sequence of 64-bit codes, below 2**61.

    With ``table``, the symbols are numbers of its codes, which then never stand in full beside the sums."""

    def __init__(self, symbols: np.ndarray, powers: Powers, table: np.ndarray | None = None):
        up, self.down = powers.of(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        for at in range(0, len(symbols), _AT_ONCE):
            part = symbols[at : at + _AT_ONCE]
            terms = _product(_reduced(part if table is None else table[part]), up[at : at + len(part)])
            self.sums[at + 1 : at + 1 + len(part)] = _reduced(_running(terms) + self.sums[at])

    def _between(self, low: np.ndarray, high: np.ndarray, down: np.ndarray) -> np.ndarray:
        return _product(_reduced(high + (_P - low)), down)

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of ``width`` symbols, by its start."""
        if len(self.sums) <= width:
            return np.zeros(0, np.uint64)
        return self._between(self.sums[:-width], self.sums[width:], self.down[: len(self.sums) - width])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._between(self.sums[starts], self.sums[ends], self.down[starts])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value of each window, by window start."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    packed = (values >> np.uint64(32) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    rest = width - span
    if rest:
        packed = np.minimum(packed[:-rest], packed[rest:])
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def starts_inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """Whether a window of ``width`` that starts at each symbol ends in the same text."""
    total = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(total) + width <= ends


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` symbols lie in a window that begins at one of ``starts``."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, total), -1)
    return np.cumsum(step[:total]) > 0


def first_of_runs(x: np.ndarray) -> np.ndarray:
    """Marks the entries that differ from the one before."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out
