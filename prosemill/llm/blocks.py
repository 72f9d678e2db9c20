"""Text in numpy: words and rolling hashes of whole Arrow columns, without a Python object for each word.

Hashes are chains of multiplications and shifts, not polynomials: a polynomial
modulo 2**64 gives equal values to texts in the order of Thue and Morse,
whatever its constants. Two hashes of different ``seed`` are independent.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text hashed at once; a longer document is a slice of its own.
SLICE = 1 << 18
#: Bytes of a word that are hashed in numpy; longer words go to XXH3 one by one.
LONG = 64
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_STARTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019))
#: Masks of the first bytes of eight.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """One value of two, in their order."""
    x = a * _STEPS[seed]
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def column(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null counts as empty."""
    x = batch.column(name)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    if isinstance(x, pa.ChunkedArray):
        x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)
    x = pc.fill_null(x.cast(pa.large_string()), "")
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = x.buffers()
    at = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), at


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of up to ``limit`` bytes or one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and where each document's words begin (n + 1). ``at`` starts at 0."""
    n = len(data)
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = at[:-1][at[:-1] < n]
    first[starts] = inside[starts]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, at)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; beyond the end stand zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word: eight bytes at a time, of all words that are as long; ``LONG`` bytes at most."""
    at, size = lanes(data), end - begin
    out = size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + _STARTS[seed]
    short = np.flatnonzero(size <= LONG)
    left, from_ = (size, begin) if len(short) == len(size) else (size[short], begin[short])
    done = 0
    while len(left):
        block = at[from_ + done] & KEEP[np.minimum(left, 8)]
        if len(short) == len(out):
            out = join(out, block, seed)
        else:
            out[short] = join(out[short], block, seed)
        more = left > 8
        done += 8
        if not more.any():
            break
        short, left, from_ = short[more], left[more] - 8, from_[more]
    if len(far := np.flatnonzero(size > LONG)):
        raw = data.tobytes()
        out[far] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], 11 + seed) for a, b in zip(begin[far].tolist(), end[far].tolist())), np.uint64, len(far))
    return mix(out)


def pieces(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE, limit: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of parts of about ``limit`` bytes; a longer document is cut between words."""
    limit = limit or SLICE
    for lo, hi in slices(at, limit):
        a, end = int(at[lo]), int(at[hi])
        while end - a > limit:
            b = a + limit
            gaps = np.flatnonzero(separator[data[a:b]])
            if not len(gaps):  # one word fills the part: go on to its end
                while b < end and not (ahead := np.flatnonzero(separator[data[b : b + limit]])).size:
                    b += limit
                b = min(end, b + int(ahead[0]) + 1) if b < end else end
            else:
                b = a + int(gaps[-1]) + 1
            yield lo, hi, a, b
            a = b
        yield lo, hi, a, end


def located(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash, start and end of every word of a column, and where each document's words begin."""
    out, begins, ends, pointers, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(at), np.int64), 0
    for lo, hi, a, b in pieces(data, at, separator):
        part, offsets = data[a:b], np.clip(at[lo : hi + 1] - a, 0, b - a)
        begin, end, p = words(part, offsets, separator)
        out.append(word_hashes(part, begin, end, seed))
        begins.append(begin + a)
        ends.append(end + a)
        pointers[lo + 1 : hi + 1] = p[1:] + base
        base += len(begin)
    return np.concatenate(out), np.concatenate(begins), np.concatenate(ends), pointers


def hashed(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a column, and where each document's words begin."""
    h, _, _, pointers = located(data, at, separator, seed)
    return h, pointers


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive words, document ends ignored: mask them with ``window_starts``.

    Windows of 2, 4, 8, ... words are joined of two; one of k words of the two that begin and end it.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    size = 1
    while size * 2 <= k:
        h = join(h[:-size], h[size:], seed)
        size *= 2
    return mix(join(h[: len(h) - (k - size)], h[k - size :], seed)) if k > size else mix(h)


def window_starts(pointers: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether a k-word window of one document starts at each of n words (its last words have none)."""
    out = np.zeros(n + 1, np.int32)
    sizes = np.diff(pointers)
    long = sizes >= k
    np.add.at(out, pointers[:-1][long], 1)
    np.add.at(out, pointers[1:][long] - k + 1, -1)
    return np.cumsum(out[:-1]) > 0


def pack(values: np.ndarray, base: int = 0) -> bytes:
    """Ascending 64-bit values as differences of one common byte width."""
    if not len(values):
        return b"\x01"
    steps = np.diff(values, prepend=np.uint64(base))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes, base: int = 0) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    width = int(raw[0])
    wide = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    wide[:, :width] = raw[1:].reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(base)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers below 2**35 in one to five bytes each, seven bits a byte, the lowest first."""
    x = values.astype(np.uint64)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14).astype(np.int64) + (x >= 1 << 21) + (x >= 1 << 28)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        own = np.flatnonzero(size > k)
        out[end[own] - size[own] + k] = ((x[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[own] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def expand(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(x < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        own = np.flatnonzero(last - first >= k)
        out[own] |= (x[first[own] + k] & 127).astype(np.int64) << (7 * k)
    return out


def bucket_edges(values: np.ndarray, bits: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """The occupied of 2**exponent buckets of ascending ``bits``-bit values, and where each begins (and the last ends)."""
    own = values >> np.uint64(bits - exponent) if exponent else np.zeros(len(values), np.uint64)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    return own[first].astype(np.int64), np.append(first, len(values))


def trim() -> None:
    """Gives freed memory back to the system: a worker outlives the stage that made it large."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
