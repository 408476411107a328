"""An FM-index of integer texts in numpy: suffix sorting, a wavelet matrix for ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes' starts in order. The first sort takes as many symbols as fit into 62 bits; then only what is still
    tied is sorted again, by doubled lengths."""
    n = len(text)
    bits = max(1, int(sigma).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(width):
        key <<= bits
        key[: n - j] |= text[j:]
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    # suffixes shorter than the width may tie with longer ones that go on with symbol 0: the sentinel is unique, so none does
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
    length = width
    while len(slots):
        who = order[slots]
        after = who + length
        tail = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + tail
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[slots] = who
        first = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(first)
        rank[who] = np.repeat(slots[heads], np.diff(np.r_[heads, len(who)]))
        slots = slots[~(first & np.r_[first[1:], True])]
        length *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit level at a time."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = sequence
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.origin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            before = ones[place]
            place = np.where((symbol >> level) & 1 == 1, zeros + before, place - before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, place) - self.origin[symbol]

    def access_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(place), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[place]
            bit = ones[place + 1] > before
            symbol = symbol * 2 + bit
            place = np.where(bit, zeros + before, place - before)
        return symbol, place - self.origin[symbol]


class FmIndex:
    """Backward search in a text of symbols 1 .. sigma-1; symbol 0 is the sentinel that the index appends."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 8) -> None:
        text = np.r_[text.astype(np.int64), 0]
        order = suffix_order(text, sigma)
        self.counts = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.ranks = WaveletMatrix(text[order - 1], sigma)
        kept = order % every == 0
        self.marked = np.r_[0, np.cumsum(kept)]
        self.samples = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the phrase, first row, last row + 1) of each phrase that occurs; phrases are rows of one length."""
        which = np.arange(len(phrases))
        low, high = self.counts[phrases[:, -1]], self.counts[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
            symbol = phrases[which, j]
            low = self.counts[symbol] + self.ranks.rank(symbol, low)
            high = self.counts[symbol] + self.ranks.rank(symbol, high)
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the left until a sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(self.marked[rows + 1] == self.marked[rows])
        while len(open_):
            symbol, before = self.ranks.access_rank(rows[open_])
            rows[open_] = self.counts[symbol] + before
            steps[open_] += 1
            open_ = open_[self.marked[rows[open_] + 1] == self.marked[rows[open_]]]
        return self.samples[self.marked[rows]] + steps
