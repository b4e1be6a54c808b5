"""Compressed FM-index over sequences of small integers, in numpy."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_SIX, _MASK = np.int64(6), np.int64(63)


class BitVector:
    """Packed bits with a count of ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> _SIX
        below = (_ONE << (at & _MASK).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Rank of any symbol in a sequence, one bit vector per bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.levels, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands in [start of its node, low) and [.., high), relative to one
        start; the difference is the number in [low, high)."""
        start = np.zeros_like(low)
        for level, zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            at = level.rank(np.concatenate([start, low, high]))
            begin, to_low, to_high = np.split(at, 3)
            start = np.where(one, zeros + begin, start - begin)
            low = np.where(one, zeros + to_low, low - to_low)
            high = np.where(one, zeros + to_high, high - to_high)
        return low - start, high - start


def _suffix_ranks(text: np.ndarray, longest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by the first 1, 2, 4 ... symbols."""
    ranks = {1: text.astype(np.int64)}
    size, width = len(text), 1
    rank = ranks[1]
    while True:
        after = np.zeros(size, dtype=np.int64)
        after[: size - width] = rank[width:] + 1
        pair = rank * (size + 2) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.zeros(size, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        width *= 2
        ranks[width] = rank = new
        if width > longest or rank.max() == size - 1:
            return order, ranks


class FmIndex:
    """Sequences of positive integers, searched backwards; matches are followed to ``depth``.

    The text is all sequences, each followed by a zero. Besides the wavelet tree of its
    Burrows-Wheeler transform the index holds, per depth, the groups of suffixes that agree in
    their first symbols: an interval of d symbols is a group of depth d, and dropping its last
    symbol widens it to a group of depth d - 1.
    """

    def __init__(self, sequences: list[np.ndarray], depth: int):
        self.depth = depth
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        text = np.zeros(int(starts[-1]), dtype=np.int64)
        for s, at in zip(sequences, starts.tolist()):
            text[at : at + len(s)] = s
        # Zeros differ, so that the order of suffixes does not run on into the next sequence.
        ends = starts[1:] - 1
        told = text + len(ends)
        told[ends] = np.arange(len(ends))
        self.suffixes, ranks = _suffix_ranks(told, int(lengths.max()) + 1)
        bits = max(1, int(text.max()).bit_length())
        self.tree = WaveletTree(text[self.suffixes - 1], bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        self.symbols = 1 << bits
        self.sequence_of = np.repeat(np.arange(len(sequences)), lengths + 1)
        common = self._common(ranks, depth)
        # Per depth the starts of the groups of suffixes that agree so far, and the end.
        self.groups = [
            np.concatenate((np.flatnonzero(common < d), [len(common)])) for d in range(depth + 1)
        ]

    def _common(self, ranks: dict[int, np.ndarray], depth: int) -> np.ndarray:
        """Symbols, ``depth`` at most, that each suffix shares with the one before; -1 for the
        first. Ranks of 8, 4, 2 and 1 symbols compare that many at a time."""
        size = len(self.suffixes)
        one, two = self.suffixes[:-1], self.suffixes[1:]
        done = np.zeros(max(0, size - 1), dtype=np.int64)
        for width in sorted(ranks, reverse=True):
            left, right = one + done, two + done
            inside = (left < size) & (right < size)
            left, right = np.minimum(left, size - 1), np.minimum(right, size - 1)
            done += width * (inside & (ranks[width][left] == ranks[width][right]))
        return np.concatenate(([-1], np.minimum(done, depth)))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Backward search: intervals of the sequences with ``symbol`` put in front."""
        to_low, to_high = self.tree.rank(symbol, low, high)
        start = self.first[symbol]
        return start + to_low, start + to_high

    def around(self, low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``depth`` symbols that hold places of the suffix array."""
        group = np.searchsorted(self.groups[depth], low, side="right") - 1
        return self.groups[depth][group], self.groups[depth][group + 1]

    def group_minimum(self, values: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The least value of the sequences in full-depth intervals, given by their starts."""
        starts = self.groups[self.depth]
        least = np.minimum.reduceat(values[self.sequence_of[self.suffixes]], starts[:-1])
        return least[np.searchsorted(starts, low, side="right") - 1]

    def matches(self, streams: list[np.ndarray]):
        """Stream sequences backwards, all together: yields (stream, place, low) for the places from
        which ``depth`` symbols occur in the index, with the start of their interval.

        The matching statistic of a place, followed to ``depth``: the longest match of what comes
        after is shortened, a symbol at a time, until the place's symbol can be put in front.
        """
        size = len(self.suffixes)
        longest = max((len(s) for s in streams), default=0)
        lengths = np.array([len(s) for s in streams], dtype=np.int64)
        # One after the other, not as rows of the longest one's width; they are read from their ends.
        symbols = np.concatenate([np.zeros(0, dtype=np.int64), *streams])
        ends, begins = np.cumsum(lengths), longest - lengths
        low = np.zeros(len(streams), dtype=np.int64)
        high = np.full(len(streams), size, dtype=np.int64)
        matched = np.zeros(len(streams), dtype=np.int64)
        alive = np.arange(len(streams))
        for at in range(longest - 1, -1, -1):
            alive = alive[begins[alive] <= at]
            waiting = alive
            shorten = waiting[matched[waiting] == self.depth]
            while True:
                for d in np.unique(matched[shorten]):
                    some = shorten[matched[shorten] == d]
                    low[some], high[some] = self.around(low[some], d - 1)
                    matched[some] = d - 1
                symbol = symbols[ends[waiting] - (longest - at)]
                known = (symbol > 0) & (symbol < self.symbols)
                new_low, new_high = self.extend(np.where(known, symbol, 0), low[waiting], high[waiting])
                fits = known & (new_low < new_high)
                some = waiting[fits]
                low[some], high[some] = new_low[fits], new_high[fits]
                matched[some] += 1
                waiting = waiting[~fits]
                shorten = waiting = waiting[matched[waiting] > 0]
                if not len(waiting):
                    break
            done = alive[matched[alive] == self.depth]
            if len(done):
                yield done, at - begins[done], low[done]
