"""Suffix arrays of a shard in numpy: Larsson-Sadakane refinement, and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

#: Bytes of the first sort's key: 257^7 < 2^63.
FIRST = 7


def suffix_array(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of strings that lie one after another in ``data``: their order, and the rank of each place.

    A string's end is smaller than all bytes, and smaller in earlier strings, so suffixes are all different and never reach
    into the next string. Each round sorts only the groups of suffixes that are equal so far, by the rank of the suffix that
    begins where the equal part ends; this doubles the depth.
    """
    n = len(data)
    string = np.repeat(np.arange(len(start)), size)
    end = np.repeat(start + size, size)
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    symbol = np.append(data.astype(np.int64) + 1, np.zeros(FIRST, np.int64))
    for k in range(FIRST):
        key *= 257
        key += np.where(at + k < end, symbol[k : n + k], 0)
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order[1:]] != key[order[:-1]])
    first = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    sizes = np.diff(np.append(first, n))
    loose = np.repeat(sizes > 1, sizes)  # places of the order that aren't settled
    depth = FIRST
    while loose.any():
        spots = np.flatnonzero(loose)
        own = order[spots]
        after = own + depth
        inside = after < end[own]
        second = np.where(inside, rank[np.minimum(after, n - 1)], string[own] - len(start))  # ends come first
        group = rank[own]
        by = np.argsort(group * (n + len(start)) + second + len(start), kind="stable")
        own, group, second = own[by], group[by], second[by]
        order[spots] = own
        head = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
        first = np.flatnonzero(head)
        sizes = np.diff(np.append(first, len(own)))
        rank[own] = np.repeat(spots[first], sizes)
        loose[spots] = np.repeat(sizes > 1, sizes)
        depth *= 2
    return order, rank


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first byte highest."""
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word |= padded[k : len(data) + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return word


def common_prefixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to ``limit``, of the prefix that each place's suffix shares with the one before it in order.

    A place's suffix shares at most one byte less than its left neighbour's did, so each string is walked once from its
    start; all strings of the shard are walked side by side.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    end = np.repeat(start + size, size)
    word = _words(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    by_size = np.argsort(-size, kind="stable")
    begin, length = start[by_size], size[by_size]
    shared = np.zeros(len(begin), np.int64)
    for step in range(int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -step, side="left"))  # the strings that reach so far
        p = begin[:m] + step
        q = before[p]
        most = np.minimum(np.minimum(end[p] - p, np.where(q >= 0, end[q] - q, 0)), limit)
        now = np.minimum(np.maximum(shared[:m] - 1, 0), most)
        open_ = np.flatnonzero(now < most)
        while len(open_):
            i, j = p[open_] + now[open_], q[open_] + now[open_]
            differ = word[i] ^ word[j]
            # equal leading bytes of the two words
            _, exponent = np.frexp((differ >> np.uint64(11)).astype(np.float64))
            equal = np.where(differ == 0, 8, np.where(differ >> np.uint64(11) == 0, 6, (53 - exponent) // 8))
            last = (differ != 0) & (differ >> np.uint64(11) == 0)
            equal[last] = np.where(differ[last] < 256, 7, 6)
            now[open_] = np.minimum(now[open_] + equal, most[open_])
            open_ = open_[(differ == 0) & (now[open_] < most[open_])]
        out[p] = now
        shared[:m] = now
    return out


def _greater(word: np.ndarray, p: np.ndarray, other: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Of strings of ``length`` bytes at places p and q: 1 where that at p is greater, -1 where it is smaller, 0 where equal."""
    out = np.zeros(len(p), np.int8)
    open_ = np.arange(len(p))
    for k in range(0, length, 8):
        shift = np.uint64(8 * max(0, 8 - (length - k)))
        x, y = word[p[open_] + k] >> shift, other[q[open_] + k] >> shift
        out[open_] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        open_ = open_[x == y]
        if not len(open_):
            break
    return out


def _laid(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size


def starts_in_both(one: list[bytes], other: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each string of two shards, which of its strings of ``length`` bytes also begin in the other shard.

    Those of ``one`` are looked up by binary search in the suffix array of ``other``, byte by byte.
    """
    data, start, size = _laid(one)
    held, held_start, held_size = _laid(other)
    hit, held_hit = np.zeros(len(data), bool), np.zeros(len(held), bool)
    places = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(start + size, size))
    if len(places) and len(held):
        order, rank = suffix_array(held, held_start, held_size)
        shared = common_prefixes(held, held_start, held_size, order, rank, length)
        by_rank = order[order + length <= np.repeat(held_start + held_size, held_size)[order]]
        group = np.cumsum(shared[by_rank] < length)  # equal strings follow one another
        word, held_word = _words(data), _words(held)
        shift = np.uint64(8 * max(0, 8 - length))
        first_words = held_word[by_rank] >> shift
        lo = np.searchsorted(first_words, word[places] >> shift, side="left")
        end = np.searchsorted(first_words, word[places] >> shift, side="right")
        hi = end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) // 2
            after = _greater(word, places[open_], held_word, by_rank[middle], length) > 0
            lo[open_] = np.where(after, middle + 1, lo[open_])
            hi[open_] = np.where(after, hi[open_], middle)
        inside = np.flatnonzero(lo < end)
        inside = inside[_greater(word, places[inside], held_word, by_rank[lo[inside]], length) == 0]
        hit[places[inside]] = True
        held_hit[by_rank] = np.isin(group, group[lo[inside]])
    own = lambda mask, starts, sizes: [mask[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return own(hit, start, size), own(held_hit, held_start, held_size)


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its strings of ``length`` bytes also begin elsewhere in the shard (in any string)."""
    data, start, size = _laid(strings)
    if not len(data):
        return [np.zeros(0, bool) for _ in strings]
    order, rank = suffix_array(data, start, size)
    shared = common_prefixes(data, start, size, order, rank, length)
    long = shared[order] >= length  # with the suffix before
    twice = np.zeros(len(data), bool)
    twice[order] = long | np.append(long[1:], False)
    return [twice[a : a + max(0, n - length + 1)] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
