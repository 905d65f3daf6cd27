"""Batches of texts as arrays: bytes, words and their 64-bit hashes.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of texts that are worked on at once; a longer text makes a chunk by itself.
CHUNK_BYTES = 1_000_000

_KEYS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts, one after another. doc: index of a word's text; per text: first word and number of words."""

    data: np.ndarray
    text_start: np.ndarray
    text_len: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    count: np.ndarray


def words(texts: list[bytes]) -> Words:
    """Split texts into words."""
    text_len = np.array([len(t) for t in texts], np.int64)
    # a blank between texts keeps their words apart
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    text_start = np.cumsum(text_len + 1) - text_len - 1
    inner = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    length = end - start
    if len(start):
        own = data[inner]
        at = np.cumsum(length) - length
        within = np.arange(len(own), dtype=np.int64) - np.repeat(at, length)
        powers = np.cumprod(np.full(int(length.max()) + 1, _ODD, np.uint64))
        found = mix(np.add.reduceat(_KEYS[own] * powers[within], at) + length.astype(np.uint64))
    else:
        found = np.zeros(0, np.uint64)
    doc = np.searchsorted(text_start, start, side="right") - 1
    count = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    return Words(data, text_start, text_len, start, length, doc, found, np.cumsum(count) - count, count)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most CHUNK_BYTES together, or of one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def lower_ascii(text: str) -> bytes:
    """UTF-8 of a text, with A-Z in lower case."""
    return text.encode().lower()
