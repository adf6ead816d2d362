"""Splitting of whole batches into the pre-tokens of the byte-level BPE pattern, and encoding by a table of pieces.

The pattern (a contraction, an optional space before letters, digits or other signs, or white space) is decided from
character classes with array operations; each distinct pre-token is encoded once and its ids are gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import regex

from barloom.llm.textops import SpanHash, ragged

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: Bytes of text that are split at a time; small, since the arrays of a pass take a hundred times as much.
SPLIT_BYTES = 512 << 10
PIECES_KEPT = 600_000

#: The endings that follow an apostrophe in the pattern.
SHORT_ENDINGS = b"stmd"
LONG_ENDINGS = (b"re", b"ve", b"ll")


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for text, base in ((low, 0), (high, 0xE000)):
        for value, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[base + m.start():base + m.end()] = value
    return table


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of every character of valid UTF-8."""
    if not len(raw) or raw.max() < 128:
        return np.arange(len(raw)), raw
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    point = raw[at].astype(np.uint32)
    lead = raw[at]
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        which = np.flatnonzero((lead >= low) & (lead < high))
        if len(which):
            value = raw[at[which]].astype(np.uint32) & mask
            for k in range(1, more + 1):
                value = (value << 6) | (raw[at[which] + k] & 0x3F)
            point[which] = value
    return at, point


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens; they cover every byte and never cross documents."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, point = code_points(raw)
    n = len(at)
    kind = classes()[point]
    char = raw[at]
    first = np.zeros(n + 1, bool)  # first characters of documents; one more for the end
    first[np.searchsorted(at, offsets[offsets < len(raw)])] = True
    first[n] = True
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    start = change[:n].copy()
    run = np.flatnonzero(change)
    begin, end = run[:-1], run[1:]
    # White space before something else: its last character stands alone or joins what follows.
    loose = (kind[begin] == SPACE) & ~first[end]
    start[end[loose] - 1] = True
    joined = end[loose][char[end[loose] - 1] == 32]
    start[joined] = False
    # Contractions: an apostrophe that begins a token, alone in its run, before lower-case endings.
    mark = begin[(char[begin] == 39) & start[begin] & (end - begin == 1) & ~first[end]]
    if len(mark):
        a, b = char[mark + 1], np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], char[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(a, list(SHORT_ENDINGS))
        long = np.zeros(len(mark), bool)
        for x, y in LONG_ENDINGS:
            long |= (a == x) & (b == y)
        for hit, size in ((mark[short], 2), (mark[long], 3)):
            start[hit + 1] = False
            rest = hit + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~first[rest]]] = True
    starts = at[start]
    return starts, np.append(starts[1:], len(raw))


class PieceTable:
    """Ids of pre-tokens, each encoded when first met; emptied when it holds ``limit`` of them.

    Pre-tokens are told apart by a 64-bit hash.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = PIECES_KEPT):
        self.encode_pieces, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        # Arrays in the order of the keys: a dictionary of as many numbers takes five times the memory.
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        found = self.encode_pieces(pieces)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + len(flat)] = flat
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(lengths) - lengths])[order]
        self.size = np.concatenate([self.size, lengths])[order]
        self.used += len(flat)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all documents and the offsets of each document among them."""
        starts, ends = pretokens(raw, offsets)
        keys, where, inverse = np.unique(SpanHash(raw).of(starts, ends), return_index=True, return_inverse=True)
        place = self._find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.keys) and len(self.keys) + len(new) > self.limit:
                self._clear()
                new = np.arange(len(keys))
            data = raw.tobytes()
            a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
            self._add(keys[new], [data[x:y] for x, y in zip(a, b, strict=True)])
            place = self._find(keys)
        place = place[inverse]
        lengths = self.size[place]
        ids = self.ids[ragged(self.begin[place], lengths)]
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        return ids, before[np.searchsorted(starts, offsets)]
