"""Words, hashes and shingles of many texts at once, in numpy.

A word is a longest run of ASCII letters, digits, ``_`` and bytes from 0x80 on, in lower case.
A shingle is ``k`` words in a row; a text with fewer words, but not none, has one shingle of all of them.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**64, (64, 256), dtype=np.uint64)
_POWER = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])  # own buffers, from offset 0
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column):
    """Lower case, also of letters beyond ASCII."""
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within each text."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, mask
    now = np.append(mask, False)
    return np.flatnonzero(now & (~before | first)), np.flatnonzero(before & (~now | first))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range (none empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inner = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(at, lengths)
    part = _TABLE.ravel()[((inner & 63) << 8) + data[inner + np.repeat(starts, lengths)]]
    if lengths.max() > 64:
        part = part * ((inner >> 6) * 2 + 1).astype(np.uint64)
    return mix(np.add.reduceat(part, at) + lengths.astype(np.uint64))


def word_hashes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a string column: hash of each word, words of each text (count), and the words' starts and ends in bytes."""
    data, offsets = buffers(lowered(column))
    starts, ends = runs(_WORD[data], offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes(data, starts, ends), counts, starts, ends


def shingles(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle in order of texts, and shingles of each text (count)."""
    n = len(words)
    out = np.maximum(counts - k + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), out
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        total[: n - j] += words[j:] * _POWER[j]
    valid = np.zeros(n, bool)
    if n >= k:
        valid[: n - k + 1] = text[k - 1 :] == text[: n - k + 1]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        a, c = first[i], counts[i]
        total[a] = (words[a : a + c] * _POWER[:c]).sum(dtype=np.uint64) + np.uint64(c)
        valid[a] = True
    return mix(total[valid]), out


def segment_reduce(ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """ufunc over each text's values along the first axis; ``empty`` where a text has none."""
    out = np.full((len(counts), *values.shape[1:]), empty, values.dtype)
    some = counts > 0
    if some.any():
        out[some] = ufunc.reduceat(values, np.concatenate(([0], np.cumsum(counts[some])[:-1])), axis=0)
    return out


def crc_mod(ids, m: int) -> np.ndarray:
    """crc32 of each id as text, modulo m."""
    import zlib

    return np.array([zlib.crc32(str(i).encode()) % m for i in ids])
