"""Sorting of many suffixes at once: a mergesort whose comparisons are binary searches over prefix hashes."""

from __future__ import annotations

import numpy as np

from venuemill.llm.rolling import Powers, PrefixHash, first_of_runs, symbol_codes

_CODES = symbol_codes(41)


class SuffixOrder:
    """The order of suffixes within groups, and the common length of each with the one before it.

    ``data`` holds the texts; suffix i is ``data[starts[i] : starts[i] + lengths[i]]``.  Two suffixes are
    compared by the longest length at which their hashes agree and the byte after it.  Runs of
    doubling width are merged in all groups at the same time: each suffix finds its rank in the other run
    by binary search.  At the end neighbours are compared byte by byte; a group in which a
    hash agreed wrongly is sorted again by its bytes.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, lengths
        self.sums = PrefixHash(data, Powers(), _CODES)
        self.top = int(lengths.max(initial=0))
        self.order = np.argsort(groups, kind="stable")
        self.groups = groups[self.order]
        self._merge()
        self._verify()

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, by their hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        a, b = self.starts[i], self.starts[j]
        for _ in range(int(self.top).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.sums.ranges(a, a + mid) == self.sums.ranges(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        end_i, end_j = n >= self.lengths[i], n >= self.lengths[j]
        last = len(self.data) - 1
        by_byte = self.data[np.minimum(self.starts[i] + n, last)] < self.data[np.minimum(self.starts[j] + n, last)]
        return np.where(end_i & end_j, or_equal, np.where(end_i, True, np.where(end_j, False, by_byte)))

    def _merge(self) -> None:
        first = np.flatnonzero(first_of_runs(self.groups))
        sizes = np.diff(np.append(first, len(self.groups)))
        begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < int(sizes.max(initial=0)):
            at = np.flatnonzero(size > width)  # the others are done
            inside = at - begin[at]
            run = inside // width
            left = run % 2 == 0
            other = begin[at] + np.where(left, run + 1, run - 1) * width
            pair = begin[at] + (run - run % 2) * width
            other_n = np.clip(begin[at] + size[at] - other, 0, width)
            low, high = np.zeros(len(at), np.int64), other_n
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                mine, theirs = self.order[at[open_]], self.order[other[open_] + mid]
                # of equal suffixes those of the left run come first
                before = self.less(theirs, mine, ~left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            place = pair + inside % width + low
            moved = self.order.copy()
            moved[place] = self.order[at]
            self.order = moved
            width *= 2

    def _verify(self) -> None:
        self.lcp = np.zeros(len(self.order), np.int64)
        bad = []
        for at in range(1, len(self.order), 20_000):
            j = self.order[at : at + 20_000]
            i = self.order[at - 1 : at - 1 + len(j)]
            same = self.groups[at : at + len(j)] == self.groups[at - 1 : at - 1 + len(j)]
            width = np.minimum(self.lengths[i], self.lengths[j])
            step = np.arange(self.top)
            last = len(self.data) - 1
            differs = self.data[np.minimum(self.starts[i][:, None] + step, last)] != self.data[np.minimum(self.starts[j][:, None] + step, last)]
            differs |= step >= width[:, None]
            true = np.where(differs.any(1), differs.argmax(1), self.top) if self.top else width
            self.lcp[at : at + len(j)] = np.where(same, true, 0)
            bad.append(np.unique(self.groups[at : at + len(j)][same & (true != self.common(i, j))]))
        for group in np.unique(np.concatenate(bad)) if bad else ():
            at = np.flatnonzero(self.groups == group)
            text = lambda k: self.data[self.starts[k] : self.starts[k] + self.lengths[k]].tobytes()
            own = sorted(self.order[at].tolist(), key=text)
            self.order[at] = own
            for place, i, j in zip(at[1:].tolist(), own, own[1:]):
                x, y = text(i), text(j)
                self.lcp[place] = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
