"""Words and word hashes of texts, as bytes and numpy arrays.

Words are runs of anything but ASCII white space (0x20, 0x09-0x0D), which is how ``bytes.split()`` splits.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .held import held

#: Distinct words kept in a worker's hash table before it is emptied; only speed depends on it.
CACHE_WORDS = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def split(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word, the same on every worker."""
    known = held("words", dict)
    found = list(map(known.get, words))
    if None in found:
        if len(known) > CACHE_WORDS:
            known.clear()
        for i, h in enumerate(found):
            if h is None:
                found[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(found, dtype=np.uint64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` consecutive words; empty if there are fewer."""
    return _mixed(hashes, size, slice(0, max(0, len(hashes) - size + 1)))


def windows_at(hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """Of ``windows`` only those that start at ``starts``."""
    return _mixed(hashes, size, starts)


def _mixed(hashes: np.ndarray, size: int, starts: slice | np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes[starts]), np.uint64)
    for i in range(size):
        at = slice(starts.start + i, starts.stop + i) if isinstance(starts, slice) else starts + i
        out += hashes[at] * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles of the lower-cased (A-Z) text.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    words = split(text, lower=True)
    return np.unique(windows(word_hashes(words), min(size, len(words)))) if words else np.empty(0, np.uint64)
