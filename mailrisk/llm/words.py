"""Word and hash helpers that run inside tasks, on one text at a time."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15  # odd, so it can be inverted modulo 2**64
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)
_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


KEPT: list[dict] = []  # caches that a worker keeps from task to task


def free_kept() -> None:
    """Empty the caches that tasks of another kind left in this worker, and give unused buffers back."""
    for cache in KEPT:
        cache.clear()
    give_back()


def give_back() -> None:
    """Return memory that earlier tasks of this worker freed, to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words with ASCII punctuation taken as white space."""
    return [] if text is None else text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of 64-bit values (the finishing steps of a public integer mixer)."""
    h = h + np.uint64(seed * _BASE & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 4096)
        inverse = pow(_BASE, -1, 2**64)
        one = np.ones(1, dtype=np.uint64)
        _POWERS = np.concatenate((one, np.cumprod(np.full(size, _BASE, dtype=np.uint64))))
        _INVERSES = np.concatenate((one, np.cumprod(np.full(size, inverse, dtype=np.uint64))))
    return _POWERS[:n], _INVERSES[:n]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values: a polynomial modulo 2**64, then mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    powers, inverses = _powers(len(h))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * powers)))
    return mix((sums[width:] - sums[:-width]) * inverses[:n], width)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    if len(values) < width:
        return np.empty(0, dtype=values.dtype)
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
