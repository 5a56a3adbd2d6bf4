"""Columnar word kernels: whole batches of text as one byte buffer.

Every word-level operator of this subpackage starts here. A batch of texts is
concatenated into a single UTF-8 buffer (one separator byte between texts, so no
word crosses a text), split at separator bytes with numpy, and each word gets a
64-bit polynomial hash read off two prefix sums. No Python object per word is made.

Separators are all ASCII, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes that end a word, for the two word definitions in use.
#   blank: [^\x20\x09-\x0D]+      alnum: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z lower-casing)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_cache: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    got = _cache.get(kind)
    if got is None or len(got) < n:
        size = -(-n // (1 << 18)) << 18
        got = _cache[kind] = powers(_BASE if kind == "up" else _BASE_INVERSE, size)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a blank before each, and the places of those blanks and of the end. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    if n:
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = texts.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
    else:
        offsets, flat = np.zeros(1, np.int64), np.zeros(0, np.uint8)
    raw = np.full(len(flat) + n, 0x20, np.uint8)
    if len(flat):
        raw[np.arange(len(flat)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = flat
    return raw, offsets + np.arange(n + 1)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * _powers("up", len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * _powers("down", len(raw))[start] + (end - start).astype(np.uint64))


class Words:
    """The words of a batch of texts.

    raw       uint8 buffer the offsets point into (lower-cased when asked)
    start/end byte offsets of each word
    first     first[i]:first[i + 1] are the words of text i (length n_texts + 1)
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, *, separators: np.ndarray, lower: bool):
        raw, blanks = joined(texts)
        self.raw = _LOWER[raw] if lower else raw
        inside = ~separators[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(raw))
        self.first = np.searchsorted(self.start, blanks).astype(np.int64)
        self.n_texts = len(blanks) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        return span_hashes(self.raw, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def windows(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words; entry i starts at word i.

    The caller masks out the runs that cross a text (see `whole_window`).
    """
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(word_hash) + 1, np.uint64)
    np.cumsum(word_hash * _powers("up", len(word_hash)), out=total[1:])
    return mix((total[width:] - total[:n]) * _powers("down", n) + np.uint64(width))


def whole_window(first: np.ndarray, width: int) -> np.ndarray:
    """True where a window of `width` words that starts at a word stays in its text."""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + width <= ends


def pack(*columns: np.ndarray) -> bytes:
    """Equal-length arrays as one compressed blob; the first, ascending uint64, is stored as gaps."""
    codec = pa.Codec("zstd", 1)
    parts = [np.array([len(columns[0])], np.int64).tobytes()]
    for k, c in enumerate(columns):
        if k == 0:
            c = np.diff(c, prepend=np.uint64(0))
        # bytes of equal weight next to each other compress far better
        parts.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    whole = b"".join(parts)
    return np.array([len(whole)], np.int64).tobytes() + codec.compress(whole, asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """What `pack` packed; kinds are the numpy types of its columns."""
    size = int(np.frombuffer(blob[:8], np.int64)[0])
    whole = pa.Codec("zstd").decompress(blob[8:], decompressed_size=size, asbytes=True)
    n, at, out = int(np.frombuffer(whole[:8], np.int64)[0]), 8, []
    for k, kind in enumerate(kinds):
        width = np.dtype(kind).itemsize
        c = np.frombuffer(whole, np.uint8, n * width, at).reshape(width, n).T
        c = np.ascontiguousarray(c).view(kind).reshape(n)
        out.append(np.cumsum(c, dtype=np.uint64) if k == 0 else c)
        at += n * width
    return out
