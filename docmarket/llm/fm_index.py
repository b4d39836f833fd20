"""FM-index over integer symbols: backward search through wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Every 0 is a separator and differs from every other 0, by position.

    Only groups of suffixes that are still equal are sorted again. No comparison passes a separator,
    so the number of rounds is the logarithm of the longest stretch between separators.
    """
    n, zeros = len(text), text == 0
    count = int(zeros.sum())
    key = text.astype(np.int64) + count
    key[zeros] = np.arange(count)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    step = 1
    while True:
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        at = order[open_]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + step, n - 1)]
        place = np.argsort(pair, kind="stable")
        order[open_] = at[place]
        pair = pair[place]
        changed = np.ones(len(open_), dtype=bool)
        changed[1:] = pair[1:] != pair[:-1]
        new[open_] |= changed
        heads = np.where(new, np.arange(n), 0)
        first = np.maximum.accumulate(heads)
        rank[order[open_]] = first[open_]
        step *= 2


class FmIndex:
    """Index of one shard. ``text`` holds symbols 1 to ``symbols`` and separators 0, and ends with a separator."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        n = len(text)
        order = suffix_array(text)
        before = text[order - 1]  # the text is taken as a ring: its last symbol is a separator
        counts = np.bincount(text, minlength=symbols + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # first row of a symbol
        # Kept positions: every `sample`-th, and the first after a separator, so that no walk passes one.
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.positions = kept, order[kept]
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.bits = max(1, int(symbols).bit_length())
        self.levels = []
        column = before
        for level in range(self.bits - 1, -1, -1):
            bit = (column >> level & 1).astype(bool)
            ones = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, n - int(ones[-1])))
            column = np.concatenate((column[~bit], column[bit]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before a suffix in the rows below ``row``."""
        low, high = np.zeros_like(row), row
        for level, ones, zeros in self.levels:
            bit = (symbol >> level & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def before(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before each row's suffix, and the row of the suffix that starts with it."""
        symbol, low = np.zeros_like(row), np.zeros_like(row)
        for level, ones, zeros in self.levels:
            bit = (ones[row + 1] - ones[row]).astype(bool)
            symbol |= bit.astype(row.dtype) << level
            low = np.where(bit, zeros + ones[low], low - ones[low])
            row = np.where(bit, zeros + ones[row], row - ones[row])
        return symbol, self.first[symbol] + row - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) whose suffixes start with each pattern; the patterns are rows of equal length."""
        symbol = patterns[:, -1]
        low, high = self.first[symbol], self.first[symbol + 1]
        alive = np.flatnonzero(low < high)
        for at in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[alive, at]
            start = self.first[symbol]
            low[alive], high[alive] = start + self.rank(symbol, low[alive]), start + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(patterns), dtype=bool)
        found[alive] = True
        return low, np.where(found, high, low)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a kept position and add the steps."""
        out, steps, left = np.empty(len(row), dtype=np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(left):
            done = self.kept[row]
            out[left[done]] = self.positions[self.kept_before[row[done]]] + steps
            left, row = left[~done], row[~done]
            if len(left):
                row = self.before(row)[1]
            steps += 1
        return out
