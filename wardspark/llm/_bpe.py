"""Byte-level BPE inside a task: vectorised pre-tokenisation, cached pair merging.

The pre-tokens of ``public_tokenizers.PATTERN`` are found without a regex.
Every code point becomes a symbol (its class, with what a look-ahead needs
folded in), each symbol is a transition function over eight states, and
functions compose associatively.  So the text is cut into equal blocks, the
composed function of every block is built by array steps that run over all
blocks at once, a doubling scan composes the blocks, and a last sweep from the
then known entry states marks where tokens begin.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from wardspark.llm._words import slices

# States: what the token that the last code point belongs to can still take.
DONE, LETTERS, NUMBERS, OTHERS, BLANKS, PREFIX, ONE_MORE, TWO_MORE = range(8)
# Symbols.  SHORT, LONG: an apostrophe with s, t, m, d or re, ve, ll behind it.
# SPACE, GAP: U+0020 or another blank with a non-blank behind it; BLANK: any
# other blank.  +8: the first code point of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, GAP, BLANK = range(8)

_FRESH = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: ONE_MORE, LONG: TWO_MORE, SPACE: PREFIX, GAP: DONE, BLANK: BLANKS}
_STAYS = {
    (LETTERS, LETTER): LETTERS, (NUMBERS, NUMBER): NUMBERS, (BLANKS, BLANK): BLANKS, (TWO_MORE, LETTER): ONE_MORE, (ONE_MORE, LETTER): DONE,
    (OTHERS, OTHER): OTHERS, (OTHERS, SHORT): OTHERS, (OTHERS, LONG): OTHERS,
    (PREFIX, LETTER): LETTERS, (PREFIX, NUMBER): NUMBERS, (PREFIX, OTHER): OTHERS, (PREFIX, SHORT): OTHERS, (PREFIX, LONG): OTHERS,
}
_NEXT = np.array([[_FRESH[y % 8] if y >= 8 else _STAYS.get((s, y), _FRESH[y % 8]) for s in range(8)] for y in range(16)], dtype=np.uint8).ravel()
_CUTS = np.array([[y >= 8 or (s, y) not in _STAYS for s in range(8)] for y in range(16)]).ravel()
_BLOCK = 64
#: White space of Unicode (fixed values).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE or BLANK of every code point."""
    if not _classes:
        kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
        of = {"L": LETTER, "N": NUMBER}
        for i in range(sys.maxunicode + 1):
            kind = of.get(unicodedata.category(chr(i))[0])
            if kind is not None:
                kinds[i] = kind
        kinds[_WHITE] = BLANK
        kinds[0x20] = SPACE
        _classes.append(kinds)
    return _classes[0]


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of every code point; firsts: where texts begin."""
    kind = _class_table()[points]
    n = len(points)
    begins = np.zeros(n + 2, dtype=bool)
    begins[firsts] = True
    begins[n:] = True
    solid = np.zeros(n + 1, dtype=bool)
    solid[:n] = kind < SPACE
    solid[:n] &= ~begins[:n]  # as seen from the code point before: a text's end is no non-blank
    out = kind.copy()
    behind = solid[1 : n + 1]
    blank = kind >= SPACE
    out[blank & ~behind] = BLANK
    out[(kind == BLANK) & behind] = GAP
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ahead = np.zeros(n + 2, dtype=points.dtype)
        ahead[:n] = points
        one = np.where(begins[quotes + 1], 0, ahead[quotes + 1])
        two = np.where((one == 0) | begins[np.minimum(quotes + 2, n)], 0, ahead[quotes + 2])
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = [(a << 21) + b for a, b in ((ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l")))]
        out[quotes[np.isin((one.astype(np.int64) << 21) + two, pair)]] = LONG
    out[firsts] += 8
    return out


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, by composing transition functions."""
    n = len(points)
    width = -(-n // _BLOCK)
    grid = np.zeros(width * _BLOCK, dtype=np.uint8)
    grid[:n] = symbols(points, firsts)
    grid = np.ascontiguousarray(grid.reshape(width, _BLOCK).T).astype(np.uint8) << 3
    whole = np.tile(np.arange(8, dtype=np.uint8), (width, 1))
    for row in grid:
        whole = _NEXT[row[:, None] + whole]
    step = 1
    while step < width:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].copy(), 1)
        step *= 2
    state = np.zeros(width, dtype=np.uint8)
    state[1:] = whole[:-1, DONE]
    cuts = np.empty((_BLOCK, width), dtype=bool)
    for k, row in enumerate(grid):
        at = row + state
        cuts[k] = _CUTS[at]
        state = _NEXT[at]
    return np.flatnonzero(cuts.T.ravel()[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of the lowest rank merges first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        parts = [piece[i : i + 1] for i in range(n)]
        far = 1 << 60
        pairs = [ranks.get(piece[i : i + 2], far) for i in range(n - 1)]
        while pairs:
            low = min(pairs)
            if low == far:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], far)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
        return [ranks[p] for p in parts]
    # Long pieces: a heap of pairs over a linked list.
    end, after, before = [i + 1 for i in range(n)], [*range(1, n), -1], [*range(-1, n - 1)]
    alive = [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or end[j] != to:
            continue
        end[i], alive[j], after[i] = to, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class _Cache(dict):
    """Pre-token to its ids as little-endian bytes; the entries of two generations are kept, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], entries: int):
        super().__init__()
        self.ranks, self.entries, self.older = ranks, entries, {}

    def __missing__(self, piece: bytes) -> bytes:
        if (out := self.older.get(piece)) is None:
            out = np.array(merged(piece, self.ranks), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


@dataclass
class Encoded:
    """One text: ids as little-endian unsigned 32-bit numbers, and the byte where each pre-token begins."""

    ids: bytes
    starts: np.ndarray


class Encoder:
    """Encodes texts by a rank file.  special: strings that are one id, found before all else."""

    def __init__(self, path: str, special: dict[str, int] | None = None, entries: int = 250_000):
        self.ranks = read_ranks(path)
        self.cache = _Cache(self.ranks, entries)
        self.special = {k.encode(): np.array([v], dtype="<u4").tobytes() for k, v in (special or {}).items()}

    def encode(self, texts: pa.Array) -> Iterator[Encoded]:
        """In order, whole texts; a null is an empty text."""
        for _, data, at in slices(texts):
            raw = data.tobytes()
            if any(k in raw for k in self.special):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    yield self._with_special(raw[a:b])
            else:
                yield from self._plain(raw, at)

    def _plain(self, raw: bytes, at: np.ndarray) -> Iterator[Encoded]:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            yield from (Encoded(b"", np.zeros(0, np.int64)) for _ in at[1:])
            return
        if len(points) == len(raw):
            byte = None
            firsts = at[:-1][at[:-1] < at[1:]]
        else:
            byte = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            firsts = np.searchsorted(byte, at[:-1][at[:-1] < at[1:]])
        starts = token_starts(points, firsts)
        starts = starts if byte is None else byte[starts]
        places = starts.tolist()
        pieces = list(map(raw.__getitem__, map(slice, places, [*places[1:], len(raw)])))
        packed = list(map(self.cache.__getitem__, pieces))
        per = np.searchsorted(starts, at).tolist()
        for k in range(len(per) - 1):
            yield Encoded(b"".join(packed[per[k] : per[k + 1]]), starts[per[k] : per[k + 1]] - at[k])

    def _with_special(self, raw: bytes) -> Encoded:
        ids, starts, begin = [], [], 0
        while begin <= len(raw):
            found = [(p, k) for k in self.special if (p := raw.find(k, begin)) >= 0]
            end, k = min(found, default=(len(raw), b""))
            part = next(self._plain(raw[begin:end], np.array([0, end - begin])))
            ids.append(part.ids)
            starts.append(part.starts + begin)
            if not k:
                break
            ids.append(self.special[k])
            starts.append(np.array([end]))
            begin = end + len(k)
        return Encoded(b"".join(ids), np.concatenate(starts))


_held: dict[tuple, Encoder] = {}


def encoder(path: str, special: dict[str, int] | None = None) -> Encoder:
    """One encoder for each file and Python worker."""
    key = (path, tuple(sorted((special or {}).items())))
    if key not in _held:
        _held[key] = Encoder(path, special)
    return _held[key]
