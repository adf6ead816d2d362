"""Vectorised work on whole batches of text: UTF-8 buffers, word spans, span hashes.

A batch is one byte array and the offsets of its documents.  Every helper costs a fixed number of passes over the
bytes, so one very long text is no worse than many short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; the arrays of a pass take some 60 times as much.
BATCH_BYTES = 2 << 20

_RNG = np.random.Generator(np.random.PCG64(20240817))
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Lower-cases A-Z and leaves every other byte.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Bytes of words made of digits, letters a-z (any case) and everything beyond ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[65:91] = ALNUM_BYTES[97:123] = ALNUM_BYTES[128:] = True

#: Bytes of words that end only at ASCII white space.
NON_SPACE_BYTES = np.ones(256, bool)
NON_SPACE_BYTES[9:14] = NON_SPACE_BYTES[32] = False


def powers(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the hash base ("up") or of its inverse ("down"), modulo 2**64."""
    if len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null counts as empty) and the offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES):
    """Parts of a record batch with about ``limit`` bytes of the column each; one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)] if len(sizes) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


class SpanHash:
    """64-bit hashes of any spans of one byte array, by prefix sums of a polynomial."""

    def __init__(self, raw: np.ndarray):
        terms = _BYTE_VALUES[raw] * powers("up", len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.down = powers("down", len(raw) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of the bytes [start, end); equal bytes give equal hashes wherever they stand."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def spans(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that do not cross documents: starts, ends, document of each."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = word_bytes[raw]
    begins = inside[1:] & ~inside[:-1]
    stops = ~inside[1:] & inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    edge = edge[inside[edge] & inside[edge + 1]]
    begins[edge] = True
    stops[edge] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def words(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = ALNUM_BYTES):
    """Lower-cased words: hash, document, starts and ends, in text order."""
    low = ASCII_LOWER[raw]
    starts, ends, doc = spans(low, offsets, word_bytes)
    return SpanHash(low).of(starts, ends), doc, starts, ends


def windows(hashes: np.ndarray, doc: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of one document: hash, document, first word.

    With ``short`` a document of one to ``width - 1`` words has one window that holds them all.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        total = total * _BASE + hashes[k:k + len(total)]
    first = np.flatnonzero(doc[:len(total)] == doc[width - 1:]) if len(total) else np.zeros(0, np.int64)
    out, of = mix(total[first]), doc[first]
    if short:
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[begin, n])
        few = begin[count < width]
        if len(few):
            lengths = count[count < width]
            value = np.zeros(len(few), np.uint64)
            for k in range(width - 1):
                live = k < lengths
                value[live] = value[live] * _BASE + hashes[few[live] + k]
            out, of, first = np.r_[out, mix(value)], np.r_[of, doc[few]], np.r_[first, few]
            order = np.argsort(first, kind="stable")
            out, of, first = out[order], of[order], first[order]
    return out, of, first


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row k holds the bytes of values[offsets[k]:offsets[k + 1]]."""
    width = values.dtype.itemsize
    at = (np.asarray(offsets, np.int64) * width).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    full = lengths > 0
    begin, size = starts[full], lengths[full]
    at = np.cumsum(size) - size
    step[at] = begin
    step[at[1:]] -= begin[:-1] + size[:-1] - 1
    return np.cumsum(step)
