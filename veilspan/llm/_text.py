"""Words and shingles of whole Arrow batches as numpy arrays, without a Python object for each word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
ODD = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64, endpoint=True) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLOCK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer; wraps around."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(int(ODD[0]), _BLOCK + 1)
_INV = _powers(pow(int(ODD[0]), -1, 2**64), _BLOCK + 1)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return b, o - o[0]


def split(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of words, and the first word of each text (n + 1 numbers)."""
    return runs(~space[buf], offs)


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are inside, none across texts, and the first run of each text (n + 1 numbers)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < len(inside)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = offs[1:][offs[1:] > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def as_strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges, in order and apart, as one string array."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    data = buf[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial by prefix sums, then mixed with the length."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = int(ends[to - 1])
        if hi - lo > _BLOCK:  # one word longer than a block
            whole, h = buf[lo:hi], U(0)
            for k in range(0, hi - lo, _BLOCK):
                part = whole[k : k + _BLOCK]
                h = mix(np.array([h ^ (BYTE[part] * _POW[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[at] = h
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(BYTE[buf[lo:hi]] * _POW[: hi - lo], out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _INV[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * ODD[1])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, also of runs that cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += words[i : i + n] * ODD[8 + i % 48]
    return mix(h)


def whole(words: np.ndarray) -> np.uint64:
    """A hash of a sequence of words, with its length."""
    h = np.array([len(words)], np.uint64)
    for i in range(len(words)):
        h = mix(h * ODD[2] + words[i : i + 1])
    return h[0]


def give_back() -> None:
    """Return what this worker has freed to the system: a worker lives on after its task, and others need the memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_TRIM = _trimmer()


def batches(it, rows_bytes: int = 4 << 20):
    """Arrow batches cut evenly so that each holds about so many bytes (or one row), and rows that 16 bits can number."""
    for batch in it:
        n = batch.num_rows
        pieces = max(1, -(-batch.nbytes // rows_bytes), -(-n // 65_535))
        step = max(1, -(-n // pieces))
        for i in range(0, n, step):
            yield batch.slice(i, step)
    give_back()


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, as bytes."""
    out = LOWER[buf]
    if len(buf) > 1:
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][second] += 32
    return out


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, which words are longer than that many bytes, and a hash of those words' first so many bytes."""
    out = []
    for n in lengths:
        long = np.flatnonzero(ends - starts > n)
        s = starts[long]
        h = np.zeros(len(s), np.uint64)
        for i in range(n):
            h += BYTE[buf[s + i]] * _POW[i]
        out.append((long, mix(h + U(n * int(ODD[3]) % 2**64))))
    return out
