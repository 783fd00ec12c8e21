"""The order of some suffixes of one block of text, by bytes and by the ranks of difference-cover samples."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np

from rollcall.llm._text import U, spread

#: Suffixes that are sorted at once; a block of more is cut by its suffixes' first bytes.
AT_ONCE = 3_000_000


@lru_cache(None)
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """v = q * q + q + 1 and q + 1 residues; any two residues mod v move into them by one common shift (q prime).

    The powers of x modulo a cubic over the field of q elements that have no square term (a perfect difference set).
    """
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        u, found = (0, 0, 1), []
        for i in range(v):
            if u[0] == 0:
                found.append(i)
            u = (u[1] + u[0] * a) % q, (u[2] + u[0] * b) % q, u[0] * c % q
        if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
            return v, np.array(found)
    raise ValueError(q)


def cover_for(length: int, window: int) -> tuple[int, np.ndarray]:
    """The largest cover of which a match of so many bytes has a common sample followed by window matching bytes."""
    best = 1, np.zeros(1, np.int64)
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31):
        if q * q + q + window <= length:
            best = difference_cover(q)
    return best


@lru_cache(None)
def shifts(v: int, cover: tuple[int, ...]) -> np.ndarray:
    """The smallest common shift by which the places a and b mod v (row, column) come to samples."""
    inside = np.zeros(2 * v, bool)
    for c in cover:
        inside[[c, c + v]] = True
    a = np.array([inside[x : x + v] for x in range(v)])  # a[x, d]: is x + d a sample?
    return np.array([(a & a[y]).argmax(1) for y in range(v)]).astype(np.int16)


class Block:
    """Suffixes at some places of a text, compared by their first depth bytes, which never pass the end of their segment.

    text: the block's bytes; end: for each byte, the end of its segment.  Memory is a few numbers for each byte.
    """

    def __init__(self, text: np.ndarray, end: np.ndarray, depth: int):
        self.depth = depth
        padded = np.concatenate([text, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(text) + 9,), ">u8", padded.data, strides=(1,))
        self.v, cover = cover_for(depth // 3, depth // 6)
        self.shift = shifts(self.v, tuple(cover.tolist()))
        self._rank_samples(len(text), end, cover)

    def word(self, places: np.ndarray, n: int = 8) -> np.ndarray:
        """The n bytes from each place as one number."""
        return self.words[places].astype(U) >> U(8 * (8 - n))

    def by_bytes(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places in the order of the n bytes that follow them, and which differ from the one before."""
        key = self.word(places, min(n, 8))
        order = np.argsort(key)
        places, key = places[order], key[order]
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        for at in range(8, n, 8):
            open_ = np.flatnonzero(~new | ~np.append(new[1:], True))  # in runs of two or more
            if not len(open_):
                break
            key = self.word(places[open_] + at, min(n - at, 8))
            first = new[open_]
            run = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            mixed = np.logical_or.reduceat(key != key[start][run], start)[run]
            some = np.flatnonzero(mixed)
            if len(some):
                o = np.lexsort((key[some], run[some]))
                sorted_key, sorted_run, where = key[some][o], run[some][o], open_[some]
                places[where] = places[where[o]]
                new[where[1:]] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_run[1:] != sorted_run[:-1])
        return places, new

    def _rank_samples(self, n: int, end: np.ndarray, cover: np.ndarray) -> None:
        """Ranks the samples, the places of the cover, by the reach bytes that follow them.

        Their first v bytes are sorted; then ranks of twice as many bytes come from pairs of ranks, as a sample moved by
        v is one.
        """
        v = self.v
        inside = np.zeros(v, bool)
        inside[cover] = True
        samples = np.flatnonzero(np.resize(inside, n) & (np.arange(n) + v <= end)) if n else np.zeros(0, int)
        self.rank = np.zeros(n, np.int32)
        places, new = self.by_bytes(samples, v)
        self.rank[places] = np.cumsum(new)
        self.reach, limit = v, self.depth - v + 1  # what is left of a match beyond any shift
        while self.reach < limit:
            step = min(self.reach, (limit - self.reach) // v * v)
            if not step:
                break
            samples = samples[samples + self.reach + step <= end[samples]]
            pair = self.rank[samples].astype(U) << U(32) | self.rank[samples + step].astype(U)
            order = np.argsort(pair)
            new = np.ones(len(pair), bool)
            new[1:] = pair[order][1:] != pair[order][:-1]
            self.rank[samples[order]] = np.cumsum(new)
            self.reach += step

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of places whose first v bytes agree: by the ranks of their common samples, and equal ranks by the last bytes."""
        d = self.shift[a % self.v, b % self.v]
        x, y = self.rank[a + d], self.rank[b + d]
        out = np.sign(x - y).astype(np.int8)
        for at in range(min(self.reach, self.depth), self.depth, 8):  # what no rank covers for sure
            same = np.flatnonzero(out == 0)
            if not len(same):
                break
            n = min(8, self.depth - at)
            x, y = self.word(a[same] + at, n), self.word(b[same] + at, n)
            out[same] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        return out

    def tied(self, places: np.ndarray) -> np.ndarray:
        """Those of the places whose first depth bytes another one shares.

        Sorted by their first v bytes; each run of equal ones is then parted around its middle one into smaller, equal
        and larger ones, until every run is equal throughout or a single suffix.
        """
        if len(places) > AT_ONCE:
            first = self.word(places)
            cuts = np.unique(np.sort(first[:: max(1, len(first) // 4096)])[:: max(1, 4096 * AT_ONCE // len(first))])
            group = np.searchsorted(cuts, first, "right")
            if len(np.unique(group)) > 1:
                return np.concatenate([self._tied(places[group == g]) for g in np.unique(group)])
        return self._tied(places)

    def _tied(self, places: np.ndarray) -> np.ndarray:
        found: list[np.ndarray] = []
        places, new = self.by_bytes(places, min(self.v, self.depth))
        open_ = ~new | ~np.append(new[1:], True)
        places, new = places[open_], new[open_]
        while len(places):
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(places)))
            c = self.compare(places, np.repeat(places[start + size // 2], size))
            run = np.repeat(np.arange(len(start)), size)
            equal = c == 0
            many = np.bincount(run, equal, len(start)) > 1
            found.append(places[equal & many[run]])
            places, part = places[~equal], 2 * run[~equal] + (c[~equal] > 0)
            order = np.argsort(part, kind="stable")
            places, part = places[order], part[order]
            new = np.ones(len(places), bool)
            new[1:] = part[1:] != part[:-1]
            open_ = ~new | ~np.append(new[1:], True)
            places, new = places[open_], new[open_]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def tied_in_segments(text: np.ndarray, start: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes at the first count places of each segment, one after another, share their first depth bytes.

    Segment k is text[start[k] : start[k] + count[k] + depth - 1]; segments follow each other.
    """
    size = count + depth - 1
    block = Block(text, np.repeat(start + size, size), depth)
    places = np.repeat(start, count) + spread(count)
    flag = np.zeros(len(text), bool)
    flag[block.tied(places)] = True
    return flag[places]
