"""Elias-Fano sequences and a trie of words and their contexts, level below level, in one memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

_U = np.uint64
_MOST_LOW = 57  # so many low bits and a shift below 8 fit one 64-bit read


class EliasFano:
    """A sorted sequence of 64-bit numbers: low bits packed, high bits in unary; successor search over arrays of keys."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.zeros = n, low_bits, lows, highs, zeros

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """Low bits per value, and the arrays that hold the sequence."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(_MOST_LOW, max(0, ((top + 1) // max(n, 1)).bit_length() - 1))
        lows = np.zeros(n * low_bits // 8 + 16, dtype=np.uint8)
        step = 1 << 16  # a multiple of 8 values fills whole bytes
        for k in range(0, n, step):
            part = values[k : k + step]
            bits = ((part[:, None] >> np.arange(low_bits, dtype=_U)) & _U(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            lows[k * low_bits // 8 : k * low_bits // 8 + len(packed)] = packed
        places = (values >> _U(low_bits)).astype(np.int64) + np.arange(n)
        words = (int(places[-1]) + 2 if n else 1) // 64 + 1
        bitmap = np.zeros(words * 64, dtype=np.uint8)
        bitmap[places] = 1
        highs = np.packbits(bitmap, bitorder="little").view("<u8")
        ones = np.bitwise_count(highs).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)]).astype(np.int64)
        return low_bits, [lows, highs.view(np.uint8), zeros.view(np.uint8)]

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=_U)
        bit = i.astype(np.int64) * self.low_bits
        eight = self.lows[(bit >> 3)[:, None] + np.arange(8)]
        return (np.ascontiguousarray(eight).view("<u8")[:, 0] >> (bit & 7).astype(_U)) & _U((1 << self.low_bits) - 1)

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits less than ``high``: from the place of the zero that closes the bucket before."""
        k = high.astype(np.int64) - 1
        out = np.zeros(len(k), dtype=np.int64)
        beyond = k >= self.zeros[-1]
        out[beyond] = self.n
        some = np.flatnonzero((k >= 0) & ~beyond)
        word = np.searchsorted(self.zeros, k[some], "right") - 1
        bits = np.unpackbits(np.ascontiguousarray(self.highs[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rank = np.cumsum(1 - bits, axis=1, dtype=np.int8)
        inside = np.argmax(rank == (k[some] - self.zeros[word] + 1).astype(np.int8)[:, None], axis=1)
        out[some] = np.minimum(word * 64 + inside - k[some], self.n)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i: the place of the one number i gives the high bits."""
        if not self.n:
            return np.zeros(len(i), dtype=_U)
        ones = np.arange(len(self.zeros)) * 64 - self.zeros  # ones before each word
        word = np.searchsorted(ones, i, "right") - 1
        bits = np.unpackbits(np.ascontiguousarray(self.highs[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rank = np.cumsum(bits, axis=1, dtype=np.int8)
        inside = np.argmax(rank == (i - ones[word] + 1).astype(np.int8)[:, None], axis=1)
        return ((word * 64 + inside - i).astype(_U) << _U(self.low_bits)) | self.low(i)

    def find(self, keys: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None, step: int = 1 << 15) -> np.ndarray:
        """The index of each key, or -1: successor search inside its bucket and, with ``within``, inside a range of places of its own."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for a in range(0, len(keys) if self.n else 0, step):
            key = keys[a : a + step]
            high, low = key >> _U(self.low_bits), key & _U((1 << self.low_bits) - 1)
            first, end = self.below(high), self.below(high + _U(1))
            if within is not None:
                first, end = np.maximum(first, within[0][a : a + step]), np.minimum(end, within[1][a : a + step])
            last = end.copy()
            while len(open_ := np.flatnonzero(first < end)):  # halves the bucket
                middle = (first[open_] + end[open_]) // 2
                less = self.low(middle) < low[open_]
                first[open_[less]], end[open_[~less]] = middle[less] + 1, middle[~less]
            at = np.flatnonzero(first < last)
            at = at[self.low(first[at]) == low[at]]
            out[a + at] = first[at]
        return out


class Trie:
    """Words, below each word the words it was seen after, below these the words before them, and so on; quantised values on every level.

    The contexts of one node are sorted and stored on top of the last value of
    the node before, so a level is monotone; pointers, monotone too, say where
    each node's contexts begin.  A context is looked up by the pointers of its
    node, the value before the first of these (the base), and a successor search
    for base + context among the node's own places.  The levels lie in one
    unlinked temporary file of the task that is mapped into memory.

    Contexts are hashes cut to BITS of their level, so two contexts of one node
    are taken for the same with chance 2**-BITS for each pair of them.
    """

    BITS = (40, 40)

    def __init__(self, words: np.ndarray, values: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], more: list[np.ndarray] = ()):
        """words: sorted; of each level the place of each context's node in the level above, the contexts, and values (uint16); (node, context) sorted.  more: further arrays to be kept beside."""
        self._file = tempfile.TemporaryFile()
        self.more = [self._mapped(x) for x in more]
        self.words, self.values, self.levels, above = self._level(words), [self._mapped(values)], [], len(words)
        for node, contexts, quantised in levels:
            begins = np.searchsorted(node, np.arange(above + 1))
            # What the nodes before add: their last contexts.
            lasts = np.where(np.diff(begins) > 0, contexts[np.maximum(begins[1:] - 1, 0)] if len(contexts) else _U(0), _U(0)).astype(_U)
            base = np.concatenate([np.zeros(1, _U), np.cumsum(lasts, dtype=_U)])
            self.levels.append((self._level(begins.astype(_U)), self._level(base[node] + contexts)))
            self.values.append(self._mapped(quantised))
            above = len(contexts)

    def _mapped(self, array: np.ndarray) -> np.ndarray:
        at = self._file.seek(0, 2)
        pad = -at % 8
        self._file.write(b"\0" * pad + array.tobytes())
        self._file.flush()
        return np.memmap(self._file, dtype=array.dtype, mode="r", offset=at + pad, shape=array.shape) if len(array) else array

    def _level(self, values: np.ndarray) -> EliasFano:
        low_bits, (lows, highs, zeros) = EliasFano.parts(values)
        return EliasFano(len(values), low_bits, self._mapped(lows), self._mapped(highs).view("<u8"), self._mapped(zeros).view(np.int64))

    def find(self, words: np.ndarray, contexts: list[np.ndarray]) -> list[np.ndarray]:
        """For each level the place of the node that each word has with its contexts so far, or -1."""
        at = self.words.find(words)
        places, known = [at], np.flatnonzero(at >= 0)
        node = at[known]
        for (pointers, level), context in zip(self.levels, contexts):
            place, of = np.unique(node, return_inverse=True)
            begin, end = (pointers.get(place + i).astype(np.int64) for i in (0, 1))
            base = np.where(begin > 0, level.get(np.maximum(begin - 1, 0)), _U(0))
            found = level.find(base[of] + context[known], (begin[of], end[of]))
            seen = np.flatnonzero(found >= 0)
            known, node = known[seen], found[seen]
            at = np.full(len(words), -1, dtype=np.int64)
            at[known] = node
            places.append(at)
        return places

    def lookup(self, words: np.ndarray, contexts: list[np.ndarray], unseen: int) -> np.ndarray:
        """The quantised value of the deepest node that each word has with its contexts; ``unseen`` if the word itself is not there."""
        out = np.full(len(words), unseen, dtype=np.uint16)
        for at, values in zip(self.find(words, contexts), self.values):
            out[at >= 0] = values[at[at >= 0]]
        return out

    def close(self) -> None:
        self.words = self.levels = self.values = self.more = None
        self._file.close()
