"""A cuckoo filter over arrays of 128-bit keys: insertion, deletion and lookup of many keys at once."""

from __future__ import annotations

import numpy as np

from venuemill.llm.rolling import mix

SLOTS = 4
ROUNDS = 400


class Cuckoo:
    """16-bit fingerprints in buckets of four; a key has two possible buckets."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(keys / (SLOTS * 0.8))).bit_length(), SLOTS), np.uint16))

    @classmethod
    def of(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    def _places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = ((high >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        return prints, (low & np.uint64(len(self.buckets) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.buckets) - 1)).astype(np.int64)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        prints, at = self._places(high, low)
        here = (self.buckets[at] == prints[:, None]).any(1)
        return here | (self.buckets[self._other(prints, at)] == prints[:, None]).any(1)

    def _put(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put what finds a free slot in its bucket; marks what did."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at)
        free = self.buckets[sorted_at] == 0
        slot_rank = np.cumsum(free, 1) - 1
        slot = np.argmax(free & (slot_rank == nth[:, None]), 1)
        fits = nth < free.sum(1)
        self.buckets[sorted_at[fits], slot[fits]] = prints[order][fits]
        done = np.zeros(len(at), bool)
        done[order[fits]] = True
        return done

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """Insert keys (each once, none that is in already); false where the filter is too full."""
        prints, at = self._places(high, low)
        rng = np.random.default_rng(len(prints))
        done = self._put(prints, at)
        prints, at = prints[~done], at[~done]
        at = self._other(prints, at)
        for _ in range(ROUNDS):
            done = self._put(prints, at)
            prints, at = prints[~done], at[~done]
            if not len(prints):
                return True
            # one waiting print of each bucket pushes out a resident, which goes to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.buckets[at[one], slot].copy()
            self.buckets[at[one], slot] = prints[one]
            prints[one] = out
            at[one] = self._other(out, at[one])
        return False

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Delete keys that are in, each once."""
        prints, at = self._places(high, low)
        for _ in range(2):
            missed, left = [np.zeros(0, np.int64)], np.arange(len(prints))
            while len(left):
                _, one = np.unique(at[left] * 65536 + prints[left], return_index=True)
                own = left[one]  # of keys alike in bucket and print, one at a time
                hit = self.buckets[at[own]] == prints[own][:, None]
                found = hit.any(1)
                self.buckets[at[own][found], hit[found].argmax(1)] = 0
                missed.append(own[~found])
                left = np.delete(left, one)
            rest = np.concatenate(missed)
            prints, at = prints[rest], self._other(prints[rest], at[rest])
