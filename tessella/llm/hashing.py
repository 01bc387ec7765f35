"""Hashes of many words at once, without a Python call for each."""

from __future__ import annotations

import numpy as np

from .sync import mixed

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def word_starts(canon: bytes) -> np.ndarray:
    """canon: words, each with a space behind it. Start of every word, and the end."""
    at = np.flatnonzero(np.frombuffer(canon, np.uint8) == 32)
    out = np.zeros(len(at) + 1, np.int64)
    out[1:] = at + 1
    return out


def prefix_sums(canon: bytes) -> np.ndarray:
    up, _ = powers(len(canon) + 1)
    out = np.zeros(len(canon) + 1, np.uint64)
    np.cumsum((np.frombuffer(canon, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(canon)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes from each start to its end, mixed."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])
