"""Sets of five-word shingles as 64-bit hashes, for Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_CACHE = 100_000
_known: dict[bytes, int] = {}
_P = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(1 << 63)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: bytes split at space and \\t to \\r, as the contracts have it."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(own: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_known) > _CACHE:
        _known.clear()
    out = list(map(_known.get, own))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = _known[own[i]] = xxhash.xxh3_64_intdigest(own[i])
    return np.array(out, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes as signed 64-bit integers.

    With fewer than five words the whole sequence is the one shingle; without words the set is empty.
    """
    own = words(text)
    if not own:
        return np.empty(0, np.int64)
    h = hashes(own)
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * _P + h[k : k + n])
    return np.unique((out ^ _SIGN).view(np.int64))
