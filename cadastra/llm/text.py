"""Tokenising and hashing of whole texts inside Arrow batches.

Texts are treated as UTF-8 bytes. Words are maximal runs of bytes outside
0x20 and 0x09-0x0D, so a word never depends on the locale. Words are hashed
8 bytes at a time with a 64-bit mixer; sequences of words are hashed from the
word hashes. Two different sequences share a 64-bit hash with a chance of 2^-64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text handled at once inside a task; bounds its arrays.
CHUNK = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U))[0])


def slices(batches, rows: int = 1500, column: str = "text", size: int = 4 << 20):
    """Arrow batches cut to so many rows and about so many bytes of a column, for steps that hold a batch's words or shingles at once."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(lengths)
        i = 0
        while i < b.num_rows:
            start = upto[i] - lengths[i]
            j = min(i + rows, b.num_rows, max(i + 1, int(np.searchsorted(upto, start + size, side="right"))))
            yield b.slice(i, j - i)
            i = j


def frugal(run):
    """A function over batches that gives freed memory back to the system at its end, as its worker stays for other steps."""

    @functools.wraps(run)
    def bounded(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return bounded


class Chunk:
    """Texts of consecutive rows: data (uint8), offs (len + 1), first row's index in the batch."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first = data, offs, first
        self.n = len(offs) - 1

    def words(self, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each text's first word (n + 1 values); apart: the bytes between words."""
        word = ~apart[self.data]
        cut = np.zeros(len(word) + 1, dtype=bool)
        cut[self.offs] = True
        before = np.empty(len(word), dtype=bool)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.empty(len(word), dtype=bool)
        if len(word):
            after[-1] = False
            after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offs)


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    """The rows of a string column, about `size` bytes at a time; a longer text comes alone. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, side="right")) - 1)
        last = min(last, len(texts))
        part = data[offs[first] : offs[last]]
        if lower:
            part = np.frombuffer(part.tobytes().translate(LOWER), dtype=np.uint8)
        yield Chunk(part, offs[first : last + 1] - offs[first], first)
        first = last


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, read 8 bytes at a time."""
    lens = (ends - starts).astype(U)
    h = mix(lens + U(0x9E3779B97F4A7C15))
    if not len(starts):
        return h
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    view = np.ndarray(shape=(len(data) + 8,), dtype="<u8", buffer=padded.data, strides=(1,))
    at, left, todo = starts, ends - starts, np.arange(len(starts))
    whole = True
    while len(todo):
        x = view[at]
        short = left < 8
        if short.any():
            x = np.where(short, x & ((U(1) << (np.minimum(left, 7).astype(U) * U(8))) - U(1)), x)
        if whole:
            h = mix(h ^ x)
        else:
            h[todo] = mix(h[todo] ^ x)
        keep = np.flatnonzero(left > 8)
        at, left, todo, whole = at[keep] + 8, left[keep] - 8, todo[keep], False
    return h


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values (fewer than k: none)."""
    if len(h) < k:
        return np.zeros(0, dtype=U)
    out = np.zeros(len(h) - k + 1, dtype=U)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * U(0x9FB21C651E98DF25)
        out ^= out >> U(29)
    return mix(out)


_R = 0xD1342543DE82EF95
_RI = pow(_R, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, dtype=U), np.full(max(0, n - 1), base, dtype=U)]))[:n]


class Rolling:
    """Hashes of all windows of w values, from prefix sums; its power tables are kept between calls."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=U)

    def __call__(self, h: np.ndarray, w: int) -> np.ndarray:
        n = len(h)
        if n < w:
            return np.zeros(0, dtype=U)
        if len(self.up) < n:
            self.up, self.down = powers(_R, n), powers(_RI, n)
        s = np.zeros(n + 1, dtype=U)
        np.cumsum(h * self.up[:n], out=s[1:])
        return mix((s[w:] - s[:-w]) * self.down[: n - w + 1])
