"""Words and word shingles of a batch of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as
a-z.  Every word gets a 64-bit hash: eight bytes at a time go through a mixing
permutation, all words of a slice at once; words beyond LONG bytes, which are
rare, through BLAKE2b.  Words of up to eight bytes and one length never share a
hash, others with chance 2**-64 (no guard against texts that are made to
collide).  Texts are taken in slices of about ``SLICE`` bytes, which bounds the
working memory; a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Words of more bytes are hashed one by one.
LONG = 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=_U)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the values then behave like random ones."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and the n + 1 places where its texts begin and end."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, size: int = SLICE, rows: int = 1 << 62) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, places) of runs of texts of about ``size`` bytes and at most ``rows`` rows."""
    data, at = buffers(texts)
    first = 0
    while first < len(at) - 1:
        last = min(first + rows, max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1))
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 places in these where each text's words begin and end; ``blank`` tells of each byte whether it ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    own = at[:-1][at[:-1] < at[1:]]
    begins[own] |= inside[own]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = own[1:] - 1
    ends[last] |= inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of a slice, in order."""
    lower = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=lower, strides=(1,))  # eight bytes from every place on
    n = ends - starts
    h = mix(n.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0xD6E8FEB86659FD93))
    for k in range(0, LONG, 8):
        at = np.flatnonzero(n > k) if k else np.arange(len(n))
        if not len(at):
            break
        lane = lanes[starts[at] + k] & _MASK[np.minimum(n[at] - k, 8)]
        h[at] = mix(h[at] * _U(0xA0761D6478BD642F) + mix(lane + _U(0xE7037ED1A0B428DB)))
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(lower[starts[i] : ends[i]], digest_size=8, key=b"words").digest(), "little")
    return h


def hashed_slice(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts of a slice, and the n + 1 places where each text's begin and end."""
    starts, ends, per = words(data, at)
    return word_hashes(data, starts, ends), per


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text of fewer words has one shingle, the whole sequence; one without
    words (empty, blank or null) has none.
    """
    for _, data, at in slices(texts):
        h, per = hashed_slice(data, at)
        n = max(0, len(h) - width + 1)
        s = np.zeros(n, dtype=_U)
        for i in range(width):
            s = mix(s * _U(0xA0761D6478BD642F) + h[i : i + n])
        for a, b in zip(per[:-1].tolist(), per[1:].tolist()):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                short = np.full(1, b - a, dtype=_U)
                for x in range(a, b):
                    short = mix(short * _U(0xE7037ED1A0B428DB) + h[x])
                yield short
            else:
                yield np.zeros(0, dtype=_U)
