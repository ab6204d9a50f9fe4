"""Which texts of a set can be alike, and how alike they are, with the ratio of the standard library's matcher."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np

#: The matcher starts from characters that are at most a hundredth of a text of so many characters or more, and from all of a shorter one.
LONG = 200
#: So many characters at a time are looked for in other texts.
GRAM = 8
#: What up to so many texts share is counted pair by pair, what more share by products of matrices of so many columns.
FEW, COLUMNS = 24, 4096


class Places:
    """A text with the places of its characters, found when they are asked for."""

    def __init__(self, text: str):
        self.text, self._places = text, {}
        counts = Counter(text)
        most = len(text) // 100 + 1 if len(text) >= LONG else len(text)
        #: The characters that a matcher starts from where this is the prior text, and how often they occur.
        self.starts = {c for c, n in counts.items() if n <= most}
        self.n_starts = sum(counts[c] for c in self.starts)

    def of(self, char: str) -> list[int]:
        found = self._places.get(char)
        if found is None:
            found = self._places[char] = [m.start() for m in re.finditer(re.escape(char), self.text)]
        return found


def _same_after(x: str, i: int, y: str, j: int, most: int) -> int:
    """How many characters from ``x[i]`` and ``y[j]`` on are the same, ``most`` at most."""
    low = 0
    while low < most:
        mid = (low + most + 1) // 2
        if x[i + low : i + mid] == y[j + low : j + mid]:
            low = mid
        else:
            most = mid - 1
    return low


def _same_before(x: str, i: int, y: str, j: int, most: int) -> int:
    low = 0
    while low < most:
        mid = (low + most + 1) // 2
        if x[i - mid : i - low] == y[j - mid : j - low]:
            low = mid
        else:
            most = mid - 1
    return low


def _runs(starts: list[int]) -> list[int]:
    """How many places in a row each place's own run has."""
    out, first = [], 0
    for n, at in enumerate(starts):
        if n + 1 == len(starts) or starts[n + 1] != at + 1:
            out += [n + 1 - first] * (n + 1 - first)
            first = n + 1
    return out


def _longest(current: Places, prior: Places, starts: list[int], lengths: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The matcher's next block between two ranges: the first longest run of starting characters, with what is the same around it."""
    x, y = current.text, prior.text
    i, j, size = alo, blo, 0
    before, last = {}, -2
    for s in range(bisect_left(starts, alo), bisect_left(starts, ahi)):
        if lengths[s] <= size:  # no run here is longer than the one that is found
            continue
        at = starts[s]
        places, runs = prior.of(x[at]), {}
        if at != last + 1:
            before = {}
        for n in range(bisect_left(places, blo), len(places)):
            to = places[n]
            if to >= bhi:
                break
            k = runs[to] = before.get(to - 1, 0) + 1
            if k > size:
                i, j, size = at - k + 1, to - k + 1, k
                if lengths[s] <= size:
                    break
        before, last = runs, at
    back = _same_before(x, i, y, j, min(i - alo, j - blo)) if size else 0
    i, j, size = i - back, j - back, size + back
    return i, j, size + _same_after(x, i + size, y, j + size, min(ahi - i, bhi - j) - size)


def matched_length(current: Places, prior: Places, least: float = 0.0) -> int:
    """The characters in all matching blocks of ``difflib.SequenceMatcher(None, current, prior)``.

    As soon as they can't give a ratio of ``least`` any more, a bound on them that is below it too.
    """
    x, y = current.text, prior.text
    starts = sorted([i for c in prior.starts for i in current.of(c)])
    lengths = _runs(starts)
    done, more, ranges = 0, min(len(x), len(y)), [(0, len(x), 0, len(y))]
    while ranges and 2.0 * (done + more) / (len(x) + len(y)) >= least:
        alo, ahi, blo, bhi = ranges.pop()
        more -= min(ahi - alo, bhi - blo)
        i, j, size = _longest(current, prior, starts, lengths, alo, ahi, blo, bhi)
        if size:
            done += size
            for r in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if room := min(r[1] - r[0], r[3] - r[2]):
                    more += room
                    ranges.append(r)
    return done + more


def grams(text: str) -> np.ndarray:
    """A hash for each run of ``GRAM`` characters; the same run again has another, so that shared ones count as often as they occur in both."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        found = found * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(found)]
    found.sort()
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, int)
    nth = np.arange(len(found)) - np.repeat(first, np.diff(np.r_[first, len(found)]))
    return found + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)


def shared_grams(texts: list[str], split: int | None = None) -> np.ndarray:
    """For each two texts (or each of the first ``split`` with each of the others) how many grams they share."""
    n, rows = len(texts), len(texts) if split is None else split
    first, columns = (0, n) if split is None else (split, n - split)
    own = [grams(t) for t in texts]
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(g) for g in own])
    tokens = np.concatenate(own)
    order = np.argsort(tokens, kind="stable")  # so the owners of a gram ascend
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(tokens)])
    out = np.zeros(rows * columns, np.float32)
    for k in range(2, FEW + 1):
        one, other = np.triu_indices(k, 1)
        at = start[size == k]
        for part in range(0, len(at), step := max(1, 4_000_000 // len(one))):
            owners = owner[at[part : part + step, None] + np.arange(k)]
            u, v = owners[:, one].ravel(), owners[:, other].ravel()
            if split is not None:
                across = (u < split) & (v >= split)
                u, v = u[across], v[across]
            out += np.bincount(u.astype(np.int64) * columns + (v - first), minlength=len(out))
    out = out.reshape(rows, columns)
    many = np.flatnonzero(size > FEW)
    for part in range(0, len(many), COLUMNS):
        at = many[part : part + COLUMNS]
        holds = np.zeros((n, len(at)), np.float32)
        holds[owner[np.repeat(start[at] - np.r_[0, np.cumsum(size[at])[:-1]], size[at]) + np.arange(size[at].sum())], np.repeat(np.arange(len(at)), size[at])] = 1
        out += holds[:rows] @ holds[first:].T
    return np.maximum(out, out.T) if split is None else out


def can_match(places: list[Places], least: float, ratio: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether the row's text can have a ratio of ``least`` to the column's as its prior, and the other way round.

    ``ratio``: that of the lengths which they must have.  No pair that has them is lost: a block of a long prior text
    holds one of its starting characters, except the block at both texts' start.  So there is one block more than
    these at most, each loses ``GRAM - 1`` grams at most, and all other grams of the blocks are shared.
    """
    lengths = np.array([len(p.text) for p in places], float)
    lost = np.array([(p.n_starts + 1) * (GRAM - 1) if len(p.text) >= LONG else np.inf for p in places])
    rows, columns = (slice(None), slice(None)) if split is None else (slice(split), slice(split, None))
    one, other = lengths[rows, None], lengths[None, columns]
    near = np.minimum(one, other) >= np.maximum(one, other) * ratio
    needed = (one + other) * (least / 2) - 1e-6
    shared = shared_grams([p.text for p in places], split)
    return near & (shared >= needed - lost[None, columns]), near & (shared >= needed - lost[rows, None])
