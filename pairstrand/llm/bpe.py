"""Byte-level BPE encoding and decoding of whole batches of texts with numpy.

Encoding goes in four steps, each over all texts of a chunk at once.

1. Words. The vocabulary's split pattern (contractions, letters, digits, other signs, white space) is applied with array
   operations on code points.
2. Forced boundaries. A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged over, so
   it marks a certain cut. Words are split there into fragments.
3. Fragments are encoded independently, each distinct one once: in every round the lowest-ranked pair of each fragment is
   merged. Fragments are found again by 64-bit keys; a key of up to seven bytes is these bytes, and longer fragments are
   compared with the bytes that are kept beside the cached ids.
4. The fragments' ids are concatenated in text order.

Strings of added tokens (such as an end-of-text mark) inside a text become that token's id, as the tokenizers library does
by default. Decoding concatenates the tokens' bytes; bytes that aren't UTF-8 become U+FFFD.

Defined results: a null text counts as empty and has no ids; texts of any length are taken whole, in chunks that hold at
least one text, so memory follows the longest text; ids out of the vocabulary decode to nothing.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

#: Fixed values of byte-level vocabularies: the white space of Unicode (property White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed values of the split pattern: contractions that are words of their own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
CHUNK_CHARS = 1_000_000
CACHE_FRAGMENTS = 400_000
#: Bytes of a fragment that is its own key.
SHORT = 7
NO_MERGE = np.int64(1) << 40


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = DIGIT
    out[WHITE_SPACE] = SPACE
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files.

    Printable Latin-1 characters stand for themselves; the others follow from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the slices [start, start + length), one slice after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Codec:
    """A byte-level vocabulary from a tokenizers JSON file.

    ``encode_fragments`` replaces step 3: it takes a list of byte strings and returns their ids.
    """

    def __init__(self, path: str, forced: bool = True, encode_fragments: Callable[[list[bytes]], list[list[int]]] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        as_bytes = {t: bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        words = [b""] * self.size
        for t, i in vocab.items():
            words[i] = as_bytes.get(t, t.encode())
        for t, i in self.special.items():
            words[i] = t.encode()
        self.token_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.token_len = np.array([len(w) for w in words], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.byte_id = np.array([vocab.get(c, 0) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        joined = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._build_pairs(left * self.size + right, np.arange(len(merges), dtype=np.int64), joined)
        inside = np.zeros((256, 256), bool)
        for t in as_bytes.values():
            b = np.frombuffer(t, np.uint8)
            inside[b[:-1], b[1:]] = True
        #: True for pairs of bytes that no token has inside.
        self.cuts = ~inside if forced else np.zeros((256, 256), bool)
        rng = np.random.default_rng(7)
        self._byte_key = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self._odd = np.uint64(0x9E3779B97F4A7C15)
        self._encode_fragments = encode_fragments
        self._clear()

    # -- pairs: an open-addressing table in arrays -------------------------------------------------------------------

    def _build_pairs(self, keys: np.ndarray, ranks: np.ndarray, joined: np.ndarray) -> None:
        self._bits = 18
        slots = 1 << self._bits
        self._slot_key, self._slot_rank, self._slot_joined = np.full(slots, -1, np.int64), np.full(slots, NO_MERGE, np.int64), np.zeros(slots, np.int64)
        for k, r, j, at in zip(keys.tolist(), ranks.tolist(), joined.tolist(), self._slot(keys).tolist(), strict=True):
            while self._slot_key[at] not in (-1, k):
                at = (at + 1) & (slots - 1)
            if self._slot_key[at] == -1:
                self._slot_key[at], self._slot_rank[at], self._slot_joined[at] = k, r, j

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each pair, or a slot without a merge."""
        at = self._slot(keys)
        found = self._slot_key[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self._bits) - 1)
            found = self._slot_key[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return at

    # -- step 1 and 2 ------------------------------------------------------------------------------------------------

    def _fragments(self, cp: np.ndarray, data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """First byte of each fragment. cp: code points; text_start: first code point of each non-empty text."""
        n = len(cp)
        cls = _classes()[cp]
        first = np.zeros(n, bool)
        first[text_start] = True
        change = first.copy()
        change[1:] |= cls[1:] != cls[:-1]
        run_last = np.ones(n, bool)
        run_last[:-1] = change[1:]
        ends_text = np.ones(n, bool)
        ends_text[:-1] = first[1:]
        start = change
        # the last white space of a run belongs to the next word if it's a blank, else it stands alone
        before_word = (cls == SPACE) & run_last & ~ends_text
        start = start | before_word
        blank = np.flatnonzero(before_word & (cp == 0x20)) + 1
        start[blank] = False
        # contractions: an apostrophe alone that begins a word
        mark = np.flatnonzero((cp == 0x27) & start & run_last & ~ends_text)
        for tail in CONTRACTIONS:
            hit = mark
            for k, c in enumerate(tail, 1):
                hit = hit[hit + k < n]
                hit = hit[(cp[hit + k] == ord(c)) & ~first[hit + k]]
            start[hit + 1] = False
            after = hit + 1 + len(tail)
            after = after[after < n]
            start[after[(cls[after] == LETTER)]] = True
            mark = np.setdiff1d(mark, hit, assume_unique=True)
        width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF) if len(data) != n else None
        at = np.flatnonzero(start)
        if width is not None:
            at = (np.cumsum(width) - width)[at]
        begins = np.zeros(len(data), bool)
        begins[at] = True
        begins[1:] |= self.cuts[data[:-1], data[1:]]
        return np.flatnonzero(begins)

    def _clear(self) -> None:
        """Forget all fragments. Stored are, one after another: number of ids and of bytes of each, the ids, the bytes."""
        self._cache: dict[int, int] = {}
        self._store: list[list[np.ndarray]] = [[], [], [], []]
        self._n_store = 0

    def _hashes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """64-bit key of each fragment: up to SHORT bytes and their number, or a hash that looks like no such key."""
        within = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()) + 1, self._odd, np.uint64))
        sums = np.add.reduceat(self._byte_key[data] * powers[within], starts)
        mixed = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed = (mixed ^ lengths.astype(np.uint64) ^ (mixed >> np.uint64(29))) | np.uint64(1 << 63)
        packed = np.add.reduceat(data.astype(np.uint64) << (8 * np.minimum(within, SHORT)).astype(np.uint64), starts)
        return np.where(lengths <= SHORT, packed | (lengths.astype(np.uint64) << np.uint64(56)), hashed)

    # -- step 3 ------------------------------------------------------------------------------------------------------

    def merge_fragments(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of fragments that lie one after another in ``data``."""
        out_len, out_ids = np.zeros(len(lengths), np.int64), np.zeros(len(data), np.int64)
        out_at = np.cumsum(lengths) - lengths
        ids, which = self.byte_id[data], np.repeat(np.arange(len(lengths)), lengths)
        live = np.arange(len(lengths))  # the fragments that are still worked on, in order
        while len(ids):
            same = which[1:] == which[:-1]
            at = self._find(ids[:-1] * self.size + ids[1:])
            rank = np.where(same & (self._slot_key[at] == ids[:-1] * self.size + ids[1:]), self._slot_rank[at], NO_MERGE)
            rank = np.append(rank, NO_MERGE)
            starts = np.flatnonzero(np.append(True, ~same))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NO_MERGE
            if done.any():
                ended = live[done]
                out_len[ended] = sizes[done]
                out_ids[ragged(out_at[ended], sizes[done])] = ids[np.repeat(done, sizes)]
                keep = np.repeat(~done, sizes)
                ids, which, rank, best, sizes, live = ids[keep], which[keep], rank[keep], best[~done], sizes[~done], live[~done]
                if not len(ids):
                    break
                at = np.append(at, 0)[keep]
            else:
                at = np.append(at, 0)
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            if len(hit) > 1:  # of overlapping equal pairs, as in aaa, every other one from the left
                new_run = np.append(True, np.diff(hit) != 1)
                run_first = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_first) % 2 == 0]
            ids[hit] = self._slot_joined[at[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, which = ids[keep], which[keep]
        filled = ragged(out_at, out_len)
        return out_ids[filled], out_len

    def _new_fragments(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = data[ragged(starts, lengths)]
        if self._encode_fragments is None:
            return self.merge_fragments(own, lengths)
        raw, ends = own.tobytes(), np.cumsum(lengths).tolist()
        lists = self._encode_fragments([raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        return np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists], np.int64)

    def _lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each fragment."""
        keys, first, back = np.unique(self._hashes(data, starts, lengths), return_index=True, return_inverse=True)
        if self._n_store > CACHE_FRAGMENTS:
            self._clear()
        get = self._cache.get
        index = np.array([get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(index < 0)
        if len(new):
            own_start, own_len = starts[first[new]], lengths[first[new]]
            ids, n = self._new_fragments(data, own_start, own_len)
            index[new] = self._n_store + np.arange(len(new))
            self._cache.update(zip(keys[new].tolist(), index[new].tolist(), strict=True))
            for store, x in zip(self._store, (n, own_len, ids, data[ragged(own_start, own_len)]), strict=True):
                store.append(x)
            self._n_store += len(new)
        self._store = [[np.concatenate(x)] if len(x) > 1 else x for x in self._store]
        all_n, all_len, all_ids, all_bytes = (x[0] for x in self._store)
        pick = index[back]
        n, begin = all_n[pick], (np.cumsum(all_n) - all_n)[pick]
        odd = self._unlike(data, starts, lengths, all_len, all_bytes, pick)
        if not len(odd):
            return all_ids[ragged(begin, n)], n
        # another fragment has the same key: these are encoded by themselves
        more_ids, more_n = self._new_fragments(data, starts[odd], lengths[odd])
        begin[odd], n[odd] = len(all_ids) + np.cumsum(more_n) - more_n, more_n
        return np.concatenate([all_ids, more_ids])[ragged(begin, n)], n

    @staticmethod
    def _unlike(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, all_len: np.ndarray, all_bytes: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """Fragments whose bytes aren't those of the stored fragment of their key; only long ones can differ."""
        long = np.flatnonzero(lengths > SHORT)
        same = lengths[long] == all_len[pick[long]]
        alike = long[same]
        if len(alike):
            n, stored = lengths[alike], (np.cumsum(all_len) - all_len)[pick[alike]]
            equal = data[ragged(starts[alike], n)] == all_bytes[ragged(stored, n)]
            same[np.flatnonzero(same)] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return long[~same]

    # -- whole texts -------------------------------------------------------------------------------------------------

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of texts without added tokens."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        cp = data if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n_chars = np.array([len(t) for t in texts], np.int64)
        text_start = (np.cumsum(n_chars) - n_chars)[n_chars > 0]
        starts = self._fragments(cp, data, text_start)
        lengths = np.diff(np.append(starts, len(data)))
        ids, n = self._lookup(data, starts, lengths)
        n_bytes = n_chars if cp is data else np.array([len(t.encode()) for t in texts], np.int64)
        ends = np.searchsorted(starts, np.cumsum(n_bytes))  # fragments before the end of each text
        total = np.append(0, np.cumsum(n))[ends]
        return ids, np.diff(np.append(0, total))

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For chunks of texts in order: the number of texts, their ids one after another, the number of ids of each."""
        texts = ["" if t is None else t for t in texts]
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            yield end - at, *self._encode_chunk(texts[at:end])
            at = end

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(s in t for s in self.special for t in texts):
            return self._encode_plain(texts)
        pieces: list[str] = []
        fixed: list[int] = []  # id after each piece, or -1
        owner: list[int] = []
        for k, t in enumerate(texts):
            while True:
                hits = [(p, -len(s), s) for s in self.special if (p := t.find(s)) >= 0]
                if not hits:
                    break
                p, _, s = min(hits)
                pieces.append(t[:p])
                fixed.append(self.special[s])
                owner.append(k)
                t = t[p + len(s) :]
            pieces.append(t)
            fixed.append(-1)
            owner.append(k)
        ids, n = self._encode_plain(pieces)
        marks = np.array(fixed, np.int64)
        ids = np.insert(ids, np.cumsum(n)[marks >= 0], marks[marks >= 0])
        return ids, np.bincount(owner, weights=n + (marks >= 0), minlength=len(texts)).astype(np.int64)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids that lie one after another, ``counts`` ids each."""
        known = (ids >= 0) & (ids < self.size)
        ids = np.where(known, ids, 0)
        n = np.where(known, self.token_len[ids], 0)
        raw = self.token_bytes[ragged(self.token_start[ids], n)].tobytes()
        ends = np.append(0, np.cumsum(n))[np.cumsum(counts)].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def library_words(path: str) -> Callable[[list[bytes]], list[list[int]]]:
    """Step 3 by the tokenizers library, which then sees each distinct word once."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    shown = {b: c for c, b in byte_alphabet().items()}

    def encode(words: list[bytes]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(w.decode("latin-1").translate(shown))] for w in words]

    return encode


@functools.cache
def codec(path: str, library: bool = False) -> Codec:
    """The codec of a worker process; with ``library``, words are split by no forced cuts and encoded by the library."""
    return Codec(path, forced=not library, encode_fragments=library_words(path) if library else None)
