"""Token ids of whole texts by a byte-level BPE vocabulary of the tokenizers library.

The library splits a text into pre-tokens (a contraction, letters, digits or other characters
with one blank before them, or white space) and encodes each for itself, so equal pre-tokens
have equal ids. Here the pre-tokens of a slab of documents are found at once in numpy and
looked up by a 64-bit hash in a table that a worker process keeps; only pre-tokens that it
does not know go to the library. Documents that contain the text of a special token are
encoded whole by the library.

The table holds at most ``MOST_ENTRIES`` pre-tokens besides those it was given at the start;
when it is full it starts afresh, which costs time and changes no result.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import span_hashes, text_bytes

MOST_ENTRIES = 1 << 19
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def classes() -> np.ndarray:
    """For each code point: letter, digit, white space or other."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    points = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start():m.end()]] = kind
    return out


def character_classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of the UTF-8 characters that begin at ``at``."""
    table = classes()
    lead = data[at]
    out = table[lead.astype(np.int64)]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        b0, p = lead[wide].astype(np.int64), at[wide]
        last = len(data) - 1
        b1, b2, b3 = (data[np.minimum(p + k, last)].astype(np.int64) & 0x3F for k in (1, 2, 3))
        two, three = (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2
        four = (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
        out[wide] = table[np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))]
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pre-token starts (it ends where the next one or the document does), and each
    document's first pre-token (one more entry at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = character_classes(data, at)
    blank, docs = data[at] == 0x20, np.searchsorted(at, offsets)
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[docs] = True
    edge = np.zeros(len(at) + 1, bool)
    edge[docs] = True
    runs = np.flatnonzero(new)
    a, b = runs[:-1], runs[1:]
    kinds, ends_document = kind[a], edge[b]
    last_blank = blank[b - 1]
    space = kinds == _SPACE
    # a last blank goes to the run after it
    attached = np.zeros(len(a), bool)
    attached[1:] = (space & last_blank & ~ends_document)[:-1] & ~space[1:]
    start = np.zeros(len(at) + 1, bool)
    start[a[~space] - attached[~space]] = True
    inner = space & ~ends_document
    start[a[space & (ends_document | (b - a > 1) | ~last_blank)]] = True
    start[b[inner & (b - a > 1) & ~last_blank] - 1] = True
    # contractions: an apostrophe by itself, then letters
    quote = np.flatnonzero((kinds == _OTHER) & (b - a == 1) & ~attached & (data[at[a]] == 0x27) & ~ends_document)
    if len(quote):
        quote = quote[kinds[quote + 1] == _LETTER]
        p, size = b[quote], b[quote + 1] - b[quote]
        letter = lambda k: np.where(size > k, data[at[np.minimum(p + k, len(at) - 1)]], 0)
        x, y = letter(0), letter(1)
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        length = np.where(one, 1, np.where(two, 2, 0))
        p, size, length = p[length > 0], size[length > 0], length[length > 0]
        start[p] = False
        start[(p + length)[size > length]] = True
    found = at[np.flatnonzero(start[:-1])]
    return found, np.searchsorted(found, offsets)


class HashTable:
    """A map from non-zero 64-bit hashes to numbers, by open addressing, for arrays at once."""

    def __init__(self, bits: int = 14) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == hashes
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        slot, mask = slot[left], len(self.keys) - 1
        while len(left):
            slot = (slot + 1) & mask
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], slot[go]
        return out

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct hashes that the table does not hold."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            held = self.keys != 0
            old = self.keys[held], self.values[held]
            self.__init__(max(self.bits + 1, int(2 * (self.n + len(hashes))).bit_length()))
            self.put(*old)
        self.n += len(hashes)
        slot, mask = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), len(self.keys) - 1
        values = values.astype(np.int32)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            mine = free & (self.keys[slot] == hashes)
            self.values[slot[mine]] = values[mine]
            hashes, values, slot = hashes[~mine], values[~mine], (slot[~mine] + 1) & mask


class Encoder:
    """Ids of texts, with a table of known pre-tokens that grows with use."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        if self.library.normalizer is not None or "ByteLevel(add_prefix_space=False" not in str(self.library.pre_tokenizer):
            raise ValueError("not a byte-level BPE vocabulary without normalizer and prefix blank")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.table, self.pool = HashTable(), np.empty(1 << 16, np.uint32)
        self.place, self.size, self.used = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        n = self.table.n
        for i in range(0, len(texts), 4096):
            got = [e.ids for e in self.library.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter((x for ids in got for x in ids), np.uint32, int(sizes.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            while n + i + len(got) > len(self.size):
                self.place, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.place, self.size))
            at = slice(n + i, n + i + len(got))
            self.place[at] = self.used + np.cumsum(sizes) - sizes
            self.size[at] = sizes
            self.pool[self.used:self.used + len(flat)] = flat
            self.used += len(flat)
        self.table.put(hashes, np.arange(n, n + len(texts)))

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The table's entry of each pre-token; those unknown are encoded first."""
        if self.table.n > MOST_ENTRIES:
            self._reset()
        found = self.table.get(hashes)
        if len(miss := np.flatnonzero(found < 0)):
            new, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            n = self.table.n
            self._learn(new, [data[a:b].tobytes().decode() for a, b in zip(starts[miss[first]].tolist(), ends[miss[first]].tolist())])
            found[miss] = n + back
        return found

    def _split(self, column: pa.ChunkedArray) -> tuple:
        data, offsets = text_bytes(column)
        starts, first = pre_tokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        return data, offsets, starts, first, ends, hashes

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[int]]:
        """Documents with the text of a special token, by the library alone."""
        raw, docs = data.tobytes(), set()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                docs.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(mark, at + 1)
        return {d: self.library.encode(raw[offsets[d]:offsets[d + 1]].decode(), add_special_tokens=False).ids for d in docs}

    def encode(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's ids start (one more
        entry at the end)."""
        data, offsets, starts, first, ends, hashes = self._split(column)
        entry = self._entries(data, starts, ends, hashes)
        size = self.size[entry].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.place[entry] - total[:-1], size) + np.arange(total[-1])]
        bounds = total[first]
        if whole := self._whole(data, offsets):
            parts = [np.array(whole[d], np.uint32) if d in whole else ids[bounds[d]:bounds[d + 1]] for d in range(len(offsets) - 1)]
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds

    def count(self, column: pa.ChunkedArray, frequent: HashTable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and ids of each text. Lengths come from the table ``frequent`` first."""
        data, offsets, starts, first, ends, hashes = self._split(column)
        size = frequent.get(hashes) if frequent is not None else np.full(len(hashes), -1, np.int32)
        if len(miss := np.flatnonzero(size < 0)):
            entry = self._entries(data, starts[miss], ends[miss], hashes[miss])
            size[miss] = self.size[entry]
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[first]
        counts = np.diff(total)
        for d, ids in self._whole(data, offsets).items():
            counts[d] = len(ids)
        return np.diff(offsets), counts


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of a worker process; its table lives from task to task."""
    return Encoder(vocabulary)
