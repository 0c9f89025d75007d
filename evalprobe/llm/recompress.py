"""Locally consistent parsing of word sequences by recompression.

Each round first names runs of one symbol, then pairs of neighbours of which the first falls left and the second
right in a split of the alphabet by a bit of the symbol's fingerprint. A name is the fingerprint of what it stands
for, so it is the same in every document and on every executor without a table of names. What a round does at a
place depends on the neighbouring symbols alone; hence equal substrings get equal symbols but for their edges.

A window of words is thus a few symbols: at every level those that its edges leave over, on the left and on the right,
and the core of the highest level that it reaches. Two windows are equal if and only if they agree in these
(``Parse.signatures``; up to collisions of the names), whatever stands around them.
"""

from __future__ import annotations

import numpy as np

from .common import mix

ROUNDS = 3


def _run_round(symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name runs, of any length. [lo, hi) are the symbols known inside each window; the runs at its edges may go on outside.

    Returns the new symbols, what of them is known inside each window, and which of the old ones these stand for.
    """
    n = len(symbols)
    first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    length = ends - starts
    run = np.cumsum(first) - 1
    with np.errstate(over="ignore"):
        named = np.where(length > 1, mix(symbols[starts] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), symbols[starts])
    a, b = ends[run[np.minimum(lo, n - 1)]], starts[run[np.maximum(hi - 1, 0)]]
    known = (lo < hi) & (a < b)
    return named, np.where(known, run[np.minimum(a, n - 1)], 0), np.where(known, run[np.maximum(b, 1) - 1] + 1, 0), a, b


def _pair_round(symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """Name pairs (left symbol, right symbol); a right symbol at the front edge or a left one at the back is unknown."""
    n = len(symbols)
    with np.errstate(over="ignore"):
        right = (mix(symbols ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
        pair = np.append(~right[:-1] & right[1:], False)
        second = np.concatenate([[False], pair[:-1]])
        following = np.append(symbols[1:], np.uint64(0))
        named = np.where(pair, mix(symbols * np.uint64(0xC2B2AE3D27D4EB4F) + mix(following)), symbols)[~second]
    index = np.concatenate([np.cumsum(~second) - 1, [int((~second).sum())]])
    a = lo + right[np.minimum(lo, n - 1)]
    b = hi - ~right[np.maximum(hi - 1, 0)]
    known = (lo < hi) & (a < b)
    return named, np.where(known, index[np.minimum(a, n)], 0), np.where(known, index[np.maximum(b, 0)], 0), a, b


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the least of values[lo:hi] stands, for many ranges (none empty)."""
    table = [np.arange(len(values))]
    widest = int((hi - lo).max())
    step = 1
    while 2 * step <= widest:
        left, right = table[-1][:-step], table[-1][step:]
        table.append(np.where(values[left] <= values[right], left, right))
        step *= 2
    level = np.int64(np.log2(hi - lo))
    best = np.zeros(len(lo), np.int64)
    for k in range(len(table)):
        at = np.flatnonzero(level == k)
        if len(at):
            left, right = table[k][lo[at]], table[k][hi[at] - (1 << k)]
            best[at] = np.where(values[left] <= values[right], left, right)
    return best


class Parse:
    """The symbols of ``words`` by level and, for every window of ``size`` words at ``starts``, what of them it determines."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, size: int, rounds: int = ROUNDS):
        symbols, lo, hi = mix(words), starts, starts + size
        #: Per level: symbols, known range, and the part of it that the next level stands for (empty: the level is the core).
        self.levels: list[tuple[np.ndarray, ...]] = []
        for k in range(rounds):
            named, lo_up, hi_up, a, b = _run_round(symbols, lo, hi)
            self.levels.append((symbols, lo, hi, a, b))
            symbols, lo, hi = named, lo_up, hi_up
            named, lo_up, hi_up, a, b = _pair_round(symbols, lo, hi, 0x9E3779B97F4A7C15 * (k + 1) & ((1 << 64) - 1))
            self.levels.append((symbols, lo, hi, a, b))
            symbols, lo, hi = named, lo_up, hi_up
        self.levels.append((symbols, lo, hi, hi, hi))

    def anchors(self) -> np.ndarray:
        """Per window a name that its words alone determine.

        It names the least (by fingerprint) of the known symbols of the highest level, with the two symbols beside it.
        Windows of equal words thus have equal anchors, whatever stands around them; so documents may follow one
        another in the words.
        """
        n = len(self.levels[0][1])
        found, open_ = np.zeros(n, np.uint64), np.arange(n)
        for k in range(len(self.levels) - 1, -1, -1):
            symbols, lo, hi = self.levels[k][:3]
            enough = hi[open_] - lo[open_] >= 3
            at = open_[enough]
            if len(at):
                with np.errstate(over="ignore"):
                    named = mix(symbols ^ np.uint64(k + 1))
                    named[1:-1] = mix(named[:-2] * np.uint64(3) + named[1:-1] * np.uint64(5) + named[2:] * np.uint64(7))
                found[at] = named[_least(named, lo[at] + 1, hi[at] - 1)]
                open_ = open_[~enough]
        return found

    def signatures(self, chosen: np.ndarray, factor: int) -> np.ndarray:
        """Of the chosen windows the fingerprint of their symbols: what the edges leave over by level, and the core."""
        out = np.zeros(len(chosen), np.uint64)
        with np.errstate(over="ignore"):
            for symbols, *ranges in self.levels:
                lo, hi, a, b = (x[chosen] for x in ranges)
                n = len(symbols)
                up = np.cumprod(np.full(n + 1, factor, np.uint64))
                down = np.cumprod(np.full(n + 1, pow(factor, -1, 1 << 64), np.uint64))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * up[:n])])

                def over(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    high = np.maximum(low, high)
                    return mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

                here, core = lo < hi, a >= b
                left, right = over(lo, np.where(core, hi, a)), over(np.where(core, hi, b), hi)
                out = np.where(here, mix(mix(out * np.uint64(3) + left) * np.uint64(5) + right + core), out)
        return out
