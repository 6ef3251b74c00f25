"""Names that a task looks other names up among.

Up to ``FEW_EDITS`` edits, two names share what is left of either after deleting at most as many letters (Bocek et al.,
2007).  Such remainders are only hashed, for all names of one length at once, and an index keeps the hashes
sorted, twelve bytes each.  Whatever shares a hash is compared, so hashes that collide cost time and no result.  Longer
names are compared where length and parity of letter pairs allow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from venuemill import fixed_values as V

#: Edits up to which names meet by the variants of the whole name (172 for 18 letters and two edits).
FEW_EDITS = 2
_EPS = 1e-9
_LEAST = V.NAME_THRESHOLD
#: The longest name with at most ``FEW_EDITS`` edits to any partner of its length or less, and the shortest with a longer partner than that.
FEW = next(n for n in range(1, 1000) if int((1.0 - _LEAST) * (n + 1) + _EPS) > FEW_EDITS)
LONG = next(n for n in range(1, 1000) if int(n / _LEAST + _EPS) > FEW)
#: Names looked up at a time, and pairs compared at a time, about.
_ROWS, _PAIRS = 1024, 1 << 20
_TABLE_BITS = 24

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_LETTER = 0xD6E8FEB86659FD93


def edits_within(one: str, two: str, most: int) -> int | None:
    """The edits between two texts, by the cells that so few of them can reach; none if there are more."""
    if abs(len(one) - len(two)) > most:
        return None
    beyond = most + 1
    row = {j: j for j in range(min(most, len(two)) + 1)}
    for i, letter in enumerate(one, 1):
        new = {}
        for j in range(max(0, i - most), min(len(two), i + most) + 1):
            cell = row.get(j, beyond) + 1
            if j:
                cell = min(cell, new.get(j - 1, beyond) + 1, row.get(j - 1, beyond) + (letter != two[j - 1]))
            new[j] = cell
        if min(new.values()) > most:
            return None
        row = new
    return row[len(two)] if row[len(two)] <= most else None


def alike(one: str, two: str, threshold: float) -> bool:
    """Whether two different names have a similarity of at least ``threshold``."""
    longer = max(len(one), len(two))
    edits = edits_within(one, two, int((1.0 - threshold) * longer + _EPS)) if one and two else None
    return edits is not None and 1.0 - edits / longer >= threshold


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + count - 1`` of all pairs, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _codes(names: list[str], width: int) -> np.ndarray:
    """A row of code points for each name, zeros behind its end."""
    return np.array(names, dtype=f"<U{width}").view(np.uint32).reshape(len(names), width)


def _by_length(names: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths of names that may have one to ``FEW_EDITS`` edits to a partner of at most ``FEW`` letters, with the places of the names."""
    lengths = np.fromiter((len(x) for x in names), np.int64, len(names))
    for n in np.unique(lengths[lengths <= FEW]).tolist():
        if _depth(n):
            yield n, np.flatnonzero(lengths == n)


def _depth(n: int) -> int:
    """The most letters of a name of this length that a partner may miss, ``FEW_EDITS`` at most."""
    return min(FEW_EDITS, int((1.0 - _LEAST) * int(n / _LEAST + _EPS) + _EPS))


def _remainders(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of what is left of names of one length after deleting letters; equal texts have equal hashes.

    A hash is a polynomial whose last letter has power 0, so letters before a deleted one lose one power."""
    n = codes.shape[1]
    step, back = np.uint64(_STEP), np.uint64(_BACK)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, step)]))[::-1]
    terms = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_LETTER) * powers
    ends = np.zeros((len(codes), n + 1), np.uint64)
    ends[:, :n] = np.cumsum(terms[:, ::-1], axis=1)[:, ::-1]
    whole, here, behind = ends[:, :1], ends[:, :n], ends[:, 1:]
    found = [whole, (whole - here) * back + behind]
    if _depth(n) > 1:
        i, j = np.triu_indices(n, 1)
        found.append(((whole - here) * back * back + behind * back)[:, i] + (behind - here * back)[:, j])
    hashes = np.concatenate(found, axis=1)
    hashes.sort(axis=1)
    first = np.ones(hashes.shape, bool)
    first[:, 1:] = hashes[:, 1:] != hashes[:, :-1]
    return np.nonzero(first)[0], hashes[first]


def _edits(one: np.ndarray, two: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """The edits between texts that are columns of code points, more than ``FEW_EDITS`` where more than that lead from one to the other.

    Texts of ``one`` have one length, those of ``two`` have ``longer`` letters more, at most ``FEW_EDITS`` either way."""
    width, far = len(two), FEW_EDITS + 1
    full = lambda value: np.full(one.shape[1], value, np.int8)
    band = {d: full(d if d >= 0 else far) for d in range(-FEW_EDITS, FEW_EDITS + 1)}
    for i in range(1, len(one) + 1):
        new: dict[int, np.ndarray] = {}
        for d in band:
            j = i + d
            if j < 1 or j > width:
                new[d] = full(min(i, far) if j == 0 else far)
                continue
            cell = band[d] + (one[i - 1] != two[j - 1])
            if d + 1 in band:
                cell = np.minimum(cell, band[d + 1] + np.int8(1))
            if d - 1 in new:
                cell = np.minimum(cell, new[d - 1] + np.int8(1))
            new[d] = cell
        band = new
    return np.choose(longer + FEW_EDITS, [band[d] for d in sorted(band)])


def _parity(name: str) -> int:
    bits = 0
    for pair in zip(name, name[1:]):
        bits ^= 1 << (hash(pair) & 63)
    return bits


class NameIndex:
    """Names, with repetitions or not, to look others up among."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.lengths = np.fromiter((len(x) for x in names), np.int64, len(names))
        self.codes = _codes([x[:FEW] for x in names], FEW)
        found = [
            (part[rows].astype(np.int32), hashes)
            for n, places in _by_length(names) for part in np.array_split(places, -(-len(places) // (_ROWS * 4)))
            for rows, hashes in [_remainders(self.codes[part, :n])]
        ]
        hashes = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.places = np.concatenate([p for p, _ in found])[order] if found else np.zeros(0, np.int32)
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True
        # (places, parities) of names that may have more than a few edits, by their length
        self.long = {
            n: (places, np.array([_parity(names[p]) for p in places], np.uint64))
            for n in np.unique(self.lengths[self.lengths >= LONG]).tolist() for places in [np.flatnonzero(self.lengths == n)]
        }

    def near(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``names``, place in the index, similarity) of different names with a similarity of at least ``NAME_THRESHOLD``, in the order of the first."""
        found = [
            pairs for n, places in _by_length(names) for part in np.array_split(places, -(-len(places) // _ROWS))
            for pairs in self._few(part, _codes([names[p] for p in part], n))
        ]
        found.extend(self._many(at, name) for at, name in enumerate(names) if len(name) >= LONG and self.long)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        left, right, similarity = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(left, kind="stable")
        return left[order], right[order], similarity[order]

    def _few(self, places: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of names of one length with names that share a remainder."""
        rows, hashes = _remainders(codes)
        seen = self.seen[hashes >> np.uint64(64 - _TABLE_BITS)]
        rows, hashes = rows[seen], hashes[seen]
        starts = np.searchsorted(self.hashes, hashes, "left")
        counts = np.searchsorted(self.hashes, hashes, "right") - starts
        total = np.cumsum(np.bincount(rows, counts, len(places))).astype(np.int64)
        # names of which each is compared with few, side by side
        for at in np.split(np.arange(len(places)), np.flatnonzero(np.diff(total // _PAIRS)) + 1):
            some = slice(*np.searchsorted(rows, [at[0], at[-1] + 1]))
            met = np.repeat(rows[some], counts[some]) * len(self.names) + self.places[ranges(starts[some], counts[some])]
            left, right = np.divmod(np.unique(met), len(self.names))
            yield self._compared(places, codes, left, right)

    def _compared(self, places: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = codes.shape[1]
        longer = self.lengths[right] - n
        other = (np.abs(longer) <= FEW_EDITS) & ((longer != 0) | (codes[left] != self.codes[right, :n]).any(axis=1))
        left, right, longer = left[other], right[other], longer[other]
        edits = _edits(codes[left].T.copy(), self.codes[right].T.copy(), longer) if len(left) else longer
        similarity = 1.0 - edits / np.maximum(self.lengths[right], n)
        good = (edits <= FEW_EDITS) & (similarity >= _LEAST)
        return places[left[good]], right[good], similarity[good]

    def _many(self, at: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of one name in which one has more than ``FEW`` letters."""
        bits, found = np.uint64(_parity(name)), []
        for n in range(int(len(name) * _LEAST - _EPS), int(len(name) / _LEAST + _EPS) + 1):
            longer = max(n, len(name))
            if longer <= FEW or n not in self.long:
                continue
            most = int((1.0 - _LEAST) * longer + _EPS)
            places, parities = self.long[n]
            for p in places[np.bitwise_count(parities ^ bits) <= 4 * most].tolist():
                edits = edits_within(name, self.names[p], most) if self.names[p] != name else None
                if edits is not None and 1.0 - edits / longer >= _LEAST:
                    found.append((p, 1.0 - edits / longer))
        places, similarity = np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.float64)
        return np.full(len(found), at), places, similarity
