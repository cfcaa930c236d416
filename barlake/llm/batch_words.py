"""Word hashes of a whole Arrow batch of texts at once, from its bytes: no Python object is made for a word.

Words are those of ``words.split``. Their hashes are others than those of ``words.word_hashes``: of the word's length and of
8 bytes at a time, each step a one-to-one map of the hash before; words of more than ``LONG`` bytes are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: The lowest 0 to 8 bytes of a number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the texts one after the other, and where each begins and the last ends; null is empty."""
    flat = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    return np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _step(hashes: np.ndarray, part: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ part) * _A
    mixed ^= mixed >> np.uint64(32)
    mixed *= _B
    return mixed ^ (mixed >> np.uint64(29))


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): a 64-bit hash of each word of ``texts``, one text after the other, and the number of words before each
    text and in all."""
    data, ends = _texts(texts)
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    gap = np.concatenate([[True], ~word, [True]])
    first = np.flatnonzero(word & (cut[:-1] | gap[:-2]))
    n = np.flatnonzero(word & (cut[1:] | gap[2:])) + 1 - first
    numbers = np.zeros(len(data) // 8 + 3, "<u8")
    numbers.view(np.uint8)[: len(data)] = data
    out = n.astype(np.uint64) * _B
    some = np.flatnonzero(n <= LONG)
    for k in range(0, LONG, 8):
        some = some[n[some] > k]
        if not len(some):
            break
        at = first[some] + k
        low = ((at & 7) << 3).astype(np.uint64)
        part = (numbers[at >> 3] >> low) | ((numbers[(at >> 3) + 1] << np.uint64(1)) << (np.uint64(63) - low))
        out[some] = _step(out[some], part & _KEEP[np.minimum(n[some] - k, 8)])
    for i in np.flatnonzero(n > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + n[i]].tobytes())
    return out, np.searchsorted(first, ends)
