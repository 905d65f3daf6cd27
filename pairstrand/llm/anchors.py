"""Anchors: places chosen by their content alone, so that equal long strings have them at equal offsets.

A window is a string of ``length`` bytes. Of its grams (strings of ``gram`` bytes) that of the smallest hash is its anchor,
the leftmost if several are; so equal windows have equal anchors at equal offsets, wherever they stand.
"""

from __future__ import annotations

import functools

import numpy as np

from pairstrand.llm.textarrays import mix

_TOP = np.iinfo(np.uint64).max
_KEYS = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
#: Low bits of a value that hold its place.
_PLACE_BITS = np.uint64(26)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, p, np.uint64)])) for p in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each string of ``gram`` bytes."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(max(20, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_KEYS[data] * power[:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each window of ``width`` values: running minima of blocks, from either side."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, _TOP, np.uint64)
    full[:n] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def anchor_runs(data: np.ndarray, wanted: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with the same anchor: first window, number of windows, hash of the anchor's gram, its place.

    ``wanted`` marks the places where windows begin; such a window has to lie within one text. ``data`` has less than 64 MB:
    longer texts come in stretches.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, np.uint64), none
    h = gram_hashes(data, gram)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)
    at = np.flatnonzero(wanted[: len(place)])
    if not len(at):
        return none, none, np.zeros(0, np.uint64), none
    own = place[at]
    new = np.append(True, (np.diff(at) != 1) | (np.diff(own) != 0))
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), h[own[first]], own[first]
