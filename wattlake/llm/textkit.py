"""Vectorised work on Arrow text columns: word bounds, word hashes, shingles, mixing.

All hashes are 64-bit and deterministic. A word's hash is a polynomial over its
bytes modulo 2**64 taken from prefix sums, then mixed; equal words hash equally
wherever they stand, in every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = U64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 19

#: ASCII white space, as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII letters, digits and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seed(*parts: int) -> np.uint64:
    x = np.array([0x243F6A8885A308D3], U64)
    for p in parts:
        x = mix(x ^ U64((p * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
    return x[0]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.full(n + 1, BASE, U64), np.full(n + 1, BASE_INVERSE, U64)
    a[0] = b[0] = 1
    return np.cumprod(a), np.cumprod(b)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one cached size for all usual chunks."""
    size = CHUNK_BYTES
    while size < n:
        size *= 2
    return _powers(size)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each; a longer text stands alone, whole."""
    _, off = text_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_bounds(raw: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each word's text number. No word crosses texts.

    ``solid`` tells the bytes of words (all but white space); a word also ends
    at the byte positions ``apart``.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    if solid is None:
        solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    edge[0] = edge[-1] = True
    if apart is not None:
        edge[apart] = True
    edge[1:-1] |= solid[1:] != solid[:-1]
    starts = np.flatnonzero(solid & edge[:-1])
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


#: Scripts written without spaces between words: South-East Asian, Chinese, Japanese, by code points from and to.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: 0 no part of a word, 1 letter, mark or digit, 2 such a one that is a word by itself."""
    import unicodedata

    kind = np.array([unicodedata.category(chr(i))[0] in "LMN" for i in range(0x110000)], np.uint8)
    for a, z in UNSPACED:
        kind[a : z + 1] *= 2
    return kind


def _wide(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, lengths and classes of the characters beyond ASCII."""
    lead = np.flatnonzero(raw >= 0xC0)
    b = raw[lead].astype(np.int64)
    n = 2 + (b >= 0xE0) + (b >= 0xF0)
    code = b & (0x7F >> n)
    for k in range(1, 4):
        at = np.flatnonzero(n > k)
        code[at] = (code[at] << 6) | (raw[lead[at] + k] & 0x3F)
    return lead, n, _classes()[np.minimum(code, 0x10FFFF)]


def plain_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a column's texts; starts, ends and text numbers of runs of letters, marks and digits.

    A character of a script without spaces is a word by itself.
    """
    raw, off = text_bytes(col)
    if not len(raw) or raw.max() < 0x80:
        low = LOWER[raw]
        return low, *word_bounds(low, off, ~NOT_ALNUM[low])
    low, off = text_bytes(pc.utf8_lower(col))
    solid = ~NOT_ALNUM[low]
    lead, n, kind = _wide(low)
    for k in range(4):
        at = lead[(kind == 0) & (n > k)]
        solid[at + k] = False
    lone = kind == 2
    return low, *word_bounds(low, off, solid, np.concatenate([lead[lone], lead[lone] + n[lone]]))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans."""
    pw, inv = powers(len(raw))
    s = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1 + 2 * salt * 0x1F3D5B79)) * pw[: len(raw)], out=s[1:])
    h = (s[ends] - s[starts]) * inv[starts]
    h ^= (ends - starts).astype(U64) << U64(40)
    return mix(h ^ seed(salt))


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``k`` successive words, their text numbers and first words' indexes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= STEP
        h += words[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), doc[at], at


def normal_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text numbers, starts and ends (in the lower-cased bytes) of the words of ``plain_words``."""
    low, starts, ends, doc = plain_words(col)
    return (span_hash(low, starts, ends) if len(starts) else np.zeros(0, U64)), doc, starts, ends
