"""FM-index over word sequences: suffix array, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Suffix array of sym by prefix doubling; every 0 counts as a separator of its own, smaller than all else."""
    n = len(sym)
    sep = sym == 0
    first = np.where(sep, np.cumsum(sep) - 1, sym + sep.sum())
    sa = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    todo, keys, k = np.arange(n), first[sa], 1
    while True:
        change = np.concatenate(([True], keys[1:] != keys[:-1]))
        group = np.maximum.accumulate(np.where(change, todo, 0))
        rank[sa[todo]] = group
        alone = change & np.concatenate((change[1:], [True]))
        todo, group = todo[~alone], group[~alone]
        if not len(todo):
            return sa
        p = sa[todo]
        key = group * (n + 1) + np.where(p + k < n, rank[np.minimum(p + k, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        sa[todo], keys = p[order], key[order]
        k *= 2


def _ranks(bits: np.ndarray) -> np.ndarray:
    rank = np.zeros(len(bits) + 1, np.int32)
    np.cumsum(bits, out=rank[1:])
    return rank


class WaveletMatrix:
    """Rank and access of any symbol of a sequence in one step per bit of the alphabet."""

    def __init__(self, levels: list[np.ndarray], n_symbols: int) -> None:
        """levels: one bit of each symbol (0 or 1), in the order of the matrix, highest bit first."""
        self.levels = levels
        self.ranks = [_ranks(x) for x in levels]
        self.zeros = [len(x) - int(r[-1]) for x, r in zip(levels, self.ranks, strict=True)]
        self.start = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    @classmethod
    def of(cls, seq: np.ndarray, n_symbols: int) -> WaveletMatrix:
        levels = []
        for b in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(np.uint8)
            levels.append(bit)
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        return cls(levels, n_symbols)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, b in enumerate(range(len(self.levels) - 1, -1, -1)):
            ones = self.ranks[level][i].astype(np.int64)
            i = np.where((c >> b) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i, element by element."""
        return self._down(c, i) - self.start[c]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        c = np.zeros(len(i), np.int64)
        for level in range(len(self.levels)):
            bit = self.levels[level][i].astype(np.int64)
            ones = self.ranks[level][i].astype(np.int64)
            c = 2 * c + bit
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return c


class FMIndex:
    """Index of one shard's word numbers (0 separates texts): counts, wavelet matrix of the last column, sampled positions.

    Of the suffix array only every sample-th text position is kept, with a bitmap that
    says which rows have one; the other positions are found by walking back.
    """

    def __init__(self, wavelet: WaveletMatrix, count: np.ndarray, keep: np.ndarray, sampled: np.ndarray) -> None:
        self.wavelet, self.count, self.keep, self.sampled = wavelet, count, keep, sampled
        self.kept = _ranks(keep)

    @classmethod
    def of(cls, sym: np.ndarray, n_symbols: int, sample: int = 16) -> FMIndex:
        sym = np.append(sym, 0)
        sa = suffix_array(sym)
        bwt = sym[sa - 1]
        keep = (sa % sample == 0) | (bwt == 0)  # a walk never crosses a separator
        count = np.concatenate(([0], np.cumsum(np.bincount(sym, minlength=n_symbols))))
        return cls(WaveletMatrix.of(bwt, n_symbols), count, keep.astype(np.uint8), sa[keep].astype(np.int32))

    def packed(self) -> bytes:
        """The index as bytes; bits take a bit each."""
        n = len(self.keep)
        head = np.array([n, len(self.wavelet.levels), len(self.count), len(self.sampled)], np.int64)
        bits = [np.packbits(x).tobytes() for x in (*self.wavelet.levels, self.keep)]
        return b"".join([head.tobytes(), self.count.astype(np.int32).tobytes(), self.sampled.tobytes(), *bits])

    @classmethod
    def unpacked(cls, data: bytes) -> FMIndex:
        n, levels, counts, sampled = np.frombuffer(data, np.int64, 4).tolist()
        at = 32
        count = np.frombuffer(data, np.int32, counts, at).astype(np.int64)
        at += 4 * counts
        places = np.frombuffer(data, np.int32, sampled, at)
        at += 4 * sampled
        size = (n + 7) // 8
        bits = [np.unpackbits(np.frombuffer(data, np.uint8, size, at + k * size), count=n) for k in range(levels + 1)]
        return cls(WaveletMatrix(bits[:-1], counts - 1), count, bits[-1], places)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows) at once: the rows found, and their suffix intervals [lo, hi)."""
        rows = np.arange(len(phrases))
        c = phrases[:, -1]
        lo, hi = self.count[c], self.count[c + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = lo < hi
            rows, lo, hi = rows[live], lo[live], hi[live]
            c = phrases[rows, k]
            lo, hi = self.count[c] + self.wavelet.rank(c, lo), self.count[c] + self.wavelet.rank(c, hi)
        live = lo < hi
        return rows[live], lo[live], hi[live]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to the nearest sampled position."""
        out = np.full(len(at), -1, np.int64)
        left, row, steps = np.arange(len(at)), at, 0
        while len(left):
            done = self.keep[row] == 1
            out[left[done]] = self.sampled[self.kept[row[done]]].astype(np.int64) + steps
            left, row = left[~done], row[~done]
            c = self.wavelet.access(row)
            row = self.count[c] + self.wavelet.rank(c, row)
            steps += 1
        return out
