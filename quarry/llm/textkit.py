"""Vectorised tokenization and rolling hashes over Arrow string buffers.

A batch of documents is one byte buffer with offsets; words are found with table lookups and
hashed with prefix sums of a polynomial modulo 2^64, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: space and \t \n \v \f \r end a word
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: everything in ASCII but digits and letters ends a word
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[ord("0") : ord("9") + 1] = NON_ALNUM[ord("a") : ord("z") + 1] = NON_ALNUM[ord("A") : ord("Z") + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: bases of two independent families of hashes; odd, so they have an inverse modulo 2^64
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)


#: bytes, or words, that hashes are computed of at a time
CHUNK = 1 << 19


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, self.n * 3 // 2)
            out = []
            for b in (self.base, self.inverse):
                p = np.full(self.n, b, U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = [_Powers(b) for b in _BYTE_BASES], [_Powers(b) for b in _WORD_BASES]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray, ends: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; a word never crosses documents."""
    n = len(buf)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~ends[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = off[(off > 0) & (off < n)]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of the words buf[s:e], which follow each other. A hash does not depend on where its word stands, so long
    buffers are gone through in runs of words of about CHUNK bytes, whose powers are all that is kept."""
    out, at = np.empty(len(s), U), 0
    while at < len(s):
        end = max(at + 1, int(np.searchsorted(e, s[at] + CHUNK, "right")))
        first, last = int(s[at]), int(e[end - 1])
        up, down = _BYTES[family].get(last - first + 1)
        total = np.zeros(last - first + 1, U)
        np.cumsum((buf[first:last].astype(U) + U(1)) * up[: last - first], out=total[1:])
        out[at:end] = mix((total[e[at:end] - first] - total[s[at:end] - first]) * down[s[at:end] - first])
        at = end
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rolling Rabin-Karp hash of every k consecutive words of one document, and where it starts; in runs of CHUNK words."""
    m = len(hashes)
    if m < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[k - 1 :] == doc[: m - k + 1])
    out = np.empty(len(at), U)
    for first in range(0, m, CHUNK):
        a, b = np.searchsorted(at, (first, first + CHUNK))
        run = hashes[first : first + CHUNK + k]
        up, down = _WORDS[family].get(len(run) + 1)
        total = np.zeros(len(run) + 1, U)
        np.cumsum(run * up[: len(run)], out=total[1:])
        here = at[a:b] - first
        out[a:b] = mix((total[here + k] - total[here]) * down[here])
    return out, at


def strings(arr: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in arr.cast(pa.large_binary() if pa.types.is_large_string(arr.type) else pa.binary()).to_pylist()]
