"""A compressed full-text index: Burrows-Wheeler transform of word numbers in a wavelet matrix with block ranks, and a sampled suffix array.

Suffixes are sorted by prefix doubling. Neither the text nor the suffix array is kept: a suffix's place is found by walking back to
the next sampled one. All searches run at once, as arrays.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 4


class Wavelet:
    """Access and rank over a sequence of small numbers: a bit vector for each binary digit, 64 bits a block with a running count."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int32))
            self.zeros.append(int((~bit).sum()))
            s = np.concatenate([s[~bit], s[bit]])
        self.begin = self.walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        block, low = i >> 6, (i & 63).astype(np.uint64)
        return self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << low) - np.uint64(1)))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self.ones(k, i)
            i = np.where(symbol >> (self.bits - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        return self.walk(symbol, i) - self.begin[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self.ones(k, i)
            symbol = symbol << 1 | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return symbol, i - self.begin[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        """text: numbers below sigma. Within, all are one more, and a last 0 ends the text."""
        text, sigma = np.append(text + 1, 0), sigma + 1
        rank, h, kinds = text.astype(np.int64), 1, 0
        while kinds < len(text):
            after = np.concatenate([rank[h:] + 1, np.zeros(min(h, len(rank)), np.int64)])[: len(rank)]
            names, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
            h, kinds = 2 * h, len(names)
        suffixes = np.argsort(rank, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = Wavelet(text[suffixes - 1], sigma)
        sampled = suffixes % SAMPLE == 0
        self.sampled = np.packbits(np.concatenate([sampled, np.zeros(-len(sampled) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.sampled))[:-1]]).astype(np.int32)
        self.places = suffixes[sampled].astype(np.int32)

    def matching(self, stream: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text, up to n: (length, low, high) for the words that end before each of the places ends.

        The match is extended to the left until it has n words or no two places of the index have it; low and high are the interval of
        the suffixes that begin with it, of two at least, or empty.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        a, b = np.zeros(len(ends), np.int64), np.full(len(ends), self.first[-1])
        for t in range(n):
            c = stream[ends[alive] - 1 - t] + 1
            a, b = (self.first[c], self.first[c + 1]) if t == 0 else (self.first[c] + self.wavelet.rank(c, a), self.first[c] + self.wavelet.rank(c, b))
            more = b - a > 1
            alive, a, b = alive[more], a[more], b[more]
            length[alive], low[alive], high[alive] = t + 1, a, b
            if not len(alive):
                break
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each of these suffixes; the first one is what follows the text."""
        out, steps, at, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows, np.arange(len(rows))
        while len(todo):
            block, low = at >> 6, (at & 63).astype(np.uint64)
            here = (self.sampled[block] >> low & np.uint64(1)).astype(bool)
            ones = self.before[block] + np.bitwise_count(self.sampled[block] & ((np.uint64(1) << low) - np.uint64(1)))
            out[todo[here]] = self.places[ones[here]] + steps[todo[here]]
            todo, at = todo[~here], at[~here]
            symbol, rank = self.wavelet.access(at)
            at = self.first[symbol] + rank
            steps[todo] += 1
        return out

    def least(self, low: np.ndarray, high: np.ndarray, priority: np.ndarray) -> np.ndarray:
        """The smallest priority of a text position in each suffix interval; intervals are equal or disjoint, and none is empty."""
        if not len(low):
            return low
        a, inverse = np.unique(low, return_inverse=True)
        b = np.zeros(len(a), np.int64)
        b[inverse] = high
        begin = np.cumsum(b - a) - (b - a)
        rows = np.arange((b - a).sum()) + np.repeat(a - begin, b - a)
        return np.minimum.reduceat(priority[self.locate(rows)], begin)[inverse]
