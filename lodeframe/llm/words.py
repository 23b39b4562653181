"""Vectorised word hashing over Arrow string columns.

A word is a longest run of bytes other than space and \\x09-\\x0D. No other
UTF-8 byte falls in that set, so working on bytes equals working on characters.
All arithmetic is modulo 2**64.

A word's hash is the sum over its blocks of 8 bytes, each mixed non-linearly with a key of its
place, mixed again with the length: no structure of letters cancels out, as it may in a polynomial. The
second hash has keys and a mixer of its own, from the bytes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E6C63D0876A9A47  # odd, so that it has an inverse
BASE2 = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: bytes outside words where punctuation counts as a separator too: ASCII but letters and digits
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: masks of the first n bytes of a block
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: bytes of text that one step works on, unless a single document is longer
STEP = 1 << 20


class Powers:
    """base**i for arrays of i, from two tables."""

    def __init__(self, base: int):
        small, step, x = [], pow(base, 1 << 16, 1 << 64), 1
        for _ in range(1 << 16):
            small.append(x)
            x = x * base & _MASK
        self.small = np.array(small, dtype=np.uint64)
        self.step, self.large = step, np.ones(1, dtype=np.uint64)

    def __call__(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, dtype=np.uint64)
        top = int(i.max()) >> 16
        if not top:
            return self.small[i]
        while len(self.large) <= top:
            self.large = np.append(self.large, np.uint64(int(self.large[-1]) * self.step & _MASK))
        return self.small[i & 0xFFFF] * self.large[i >> 16]


_POWERS: dict[int, Powers] = {}


def powers(base: int) -> Powers:
    if base not in _POWERS:
        _POWERS[base] = Powers(base)
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed2(x: np.ndarray) -> np.ndarray:
    """Another bijective finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def steps(raw: np.ndarray, offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of about `most` bytes; whole documents only."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def spans(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): bytes of each word, and by document the index of its first word, with one more at the end."""
    word = ~apart[raw]
    full = np.flatnonzero(np.diff(offsets))
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[offsets[full]] = False
    after = np.empty_like(word)
    after[:-1] = word[1:]
    after[offsets[full + 1] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; `second` gives an independent one."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    mix, salt = (mixed2, np.uint64(BASE2)) if second else (mixed, np.uint64(BASE))
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = _LOWER[raw] if lower else raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))  # the 8 bytes from each place on
    lengths = ends - starts
    out = mix((eight[starts] & _FIRST[np.minimum(lengths, 8)]) + salt)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) >> 3  # blocks after the first
        cuts = np.concatenate(([0], np.cumsum(more)[:-1]))
        j = np.arange(int(more.sum())) - np.repeat(cuts, more) + 1
        block = eight[np.repeat(starts[long], more) + 8 * j] & _FIRST[np.minimum(np.repeat(lengths[long], more) - 8 * j, 8)]
        out[long] += np.add.reduceat(mix(block + mix((j + 1).astype(np.uint64) * salt)), cuts)
    return mix(out + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def window_hashes(words: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all windows of k words: sum of word[i+j] * base**(k-1-j)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 8:
        out = words[:n].copy()
        for j in range(1, k):
            out *= np.uint64(base)
            out += words[j : j + n]
        return out
    at = np.arange(len(words))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(pow(base, -1, 1 << 64))(at))))
    return (total[k:] - total[:n]) * powers(base)(at[k - 1 :])


def kept_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the windows of k words that lie in one document."""
    counts = np.diff(first)
    full = np.maximum(counts - k + 1, 0)
    out = np.arange(full.sum())
    return out + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(full)[:-1])), full)


def shingle_counts(first: np.ndarray, k: int) -> np.ndarray:
    """By document the index of its first shingle, with one more at the end: fewer than k words make one, none makes none."""
    counts = np.diff(first)
    return np.concatenate(([0], np.cumsum(np.where(counts >= k, counts - k + 1, counts > 0))))


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's k-word shingles, repeats included; fewer words make one shingle, none makes none."""
    counts, out_first = np.diff(first), shingle_counts(first, k)
    out = np.empty(out_first[-1], dtype=np.uint64)
    long = counts >= k
    whole = window_hashes(words, k)
    fill = np.repeat(long, np.diff(out_first))
    out[fill] = mixed(whole[kept_windows(first, k)])
    for d in np.flatnonzero((counts > 0) & ~long):
        x = 0
        for w in words[first[d] : first[d + 1]]:
            x = x * BASE + int(w) & _MASK
        out[out_first[d]] = mixed(np.array([x + int(counts[d])], dtype=np.uint64) ^ np.uint64(BASE2))[0]
    return out, out_first
