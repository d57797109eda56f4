"""Vectorised 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _letters() -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_LETTERS = _letters()


def hash_words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte of each maximal run where ``inside`` holds.

    ``data`` are bytes; the hash is a polynomial of the run's bytes modulo 2**64, mixed with its length.
    """
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    n = len(data)
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers, out=sums[1:])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    raw = (sums[ends] - sums[starts]) * back[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), starts


def joined(texts: list[bytes], gap: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by a ``gap`` byte, and each text's first place."""
    data = np.frombuffer(bytes([gap]).join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return data, np.concatenate(([0], np.cumsum(lengths[:-1] + 1))) if len(texts) else np.zeros(0, np.int64)


def byte_groups(texts: list[bytes], limit: int = 2_000_000):
    """Index ranges of texts of about ``limit`` bytes together, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
