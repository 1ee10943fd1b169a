"""Encoding and decoding with a SentencePiece BPE vocabulary, by vectorised merge rounds.

A text is normalised as the vocabulary says (blanks become word marks, one is put in front),
then cut into words: up to ``longest blank piece`` word marks and the other characters after
them. No piece holds a word mark after another character, so no merge crosses a cut, and equal
words have equal pieces: each worker keeps a table of the words it has met, and only new ones are
encoded. All new words of a slab are encoded at once. Their symbols lie in one flat array; a round finds
the least pair rank of each word, merges all pairs of that rank that do not overlap, from the left,
and drops the symbols that were merged away and the words that have no pair left. The library merges
one pair at a time; where a merge of a round would make a pair of the same rank or a better one, only the
leftmost pair of that word is merged in the round, so results are those of the library always.

Characters without a piece become the pieces of their bytes. Decoding is the library's.

A null or empty text has no ids and decodes to an empty text. Rows that share an id, also rows with a null
id, are encoded each for itself; there are no ties. An empty table gives no rows. Texts of any length are
encoded whole. A table of words that is full starts afresh, which costs time and changes no result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .tokens import Encoder, HashTable
from .words import map_slabs, mix, span_hashes, text_bytes

MARK = "▁"
MOST_IDS = 1 << 22
"""Ids that a worker keeps, but for those of one slab more."""

_GROUP = 1 << 19
_NO_RANK = np.int32(2**31 - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their ranks, and which pairs of symbols merge into which piece.

    A symbol is the id of a piece, or ``size + k`` for the k-th character that stands in pieces but is none
    itself, or ``-1 - c`` for any other character c.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        kinds = type(spec.pieces[0])
        normalizer = spec.normalizer_spec
        if (spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback
                or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces
                or not (normalizer.add_dummy_prefix and normalizer.escape_whitespaces)
                or spec.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)):
            raise ValueError("not a BPE vocabulary with byte fallback, identity normalizer and word marks in front")
        self.size = len(spec.pieces)
        own = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in own):
            raise ValueError("a piece holds a word mark after another character")
        self.bytes = np.zeros(256, np.int32)
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        _, rank = np.unique([-p.score for p in spec.pieces], return_inverse=True)
        self.rank = rank.astype(np.int32)
        extra = sorted({c for p in own for c in p} - own.keys())
        symbols = own | {c: self.size + k for k, c in enumerate(extra)}
        self.extra = np.array([ord(c) for c in extra], np.int64)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        found = [(symbols[p[:k]], symbols[p[k:]], i) for p, i in own.items() for k in range(1, len(p))
                 if p[:k] in symbols and p[k:] in symbols]
        left, right, made = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = HashTable(int(4 * len(found) + 4).bit_length())
        self.pairs.put(self._keys(left, right), made)
        self.period = self._blank_period(max((len(p) for p in own if not p.strip(MARK)), default=1))

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), 0x9AE16A3B2F90404F)
        keys[keys == 0] = 1
        return keys

    def _blank_period(self, longest: int) -> int:
        """Word marks after which a long run of them may be cut: its pieces repeat from there."""
        ids = [self.encode_words([MARK * n])[0].tolist() for n in range(1, 4 * longest + 1)]
        if any(ids[n + longest - 1] != ids[longest - 1] + ids[n - 1] for n in range(1, 3 * longest + 1)):
            return 0
        return longest

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, or -1."""
        out = np.full(len(left), -1, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        out[at] = self.pairs.get(self._keys(left[at], right[at]))
        return out

    def ranks(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], _NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, one after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, sizes = self._rounds(self.symbol[points], sizes)
        return self._with_bytes(symbols, sizes)

    def _rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.arange(len(sizes))[sizes > 0]
        final_sizes, done = np.zeros(len(sizes), np.int64), []
        sizes = sizes[sizes > 0]
        made = np.full(len(symbols), -1, np.int32)
        if len(symbols):
            made[:-1] = self.merged(symbols[:-1], symbols[1:])
            made[np.cumsum(sizes) - 1] = -1
        while len(word):
            first = np.cumsum(sizes) - sizes
            ranks = self.ranks(made)
            least = np.minimum.reduceat(ranks, first)
            alive = least < _NO_RANK
            if not alive.all():
                left = np.repeat(alive, sizes)
                done.append((np.repeat(word[~alive], sizes[~alive]), symbols[~left]))
                final_sizes[word[~alive]] = sizes[~alive]
                symbols, made, ranks = symbols[left], made[left], ranks[left]
                word, sizes, least = word[alive], sizes[alive], least[alive]
                if not len(word):
                    break
                first = np.cumsum(sizes) - sizes
            at = self._chosen(symbols, made, np.flatnonzero(ranks == np.repeat(least, sizes)), first, sizes, least)
            symbols[at] = made[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            owner = np.searchsorted(first, at, "right") - 1
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            symbols, made = symbols[stays], made[stays]
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(sizes) - 1] = True
            at = at - np.arange(len(at))
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            made[again] = -1
            again = again[~last[again]]
            made[again] = self.merged(symbols[again], symbols[again + 1])
        if not done:
            return symbols, final_sizes
        owners, flat = (np.concatenate(x) for x in zip(*done))
        return flat[np.argsort(owners, kind="stable")], final_sizes

    def _chosen(self, symbols: np.ndarray, made: np.ndarray, hits: np.ndarray, first: np.ndarray, sizes: np.ndarray,
                least: np.ndarray) -> np.ndarray:
        """The pairs that a round merges, out of those of the least rank of their words."""
        new = np.ones(len(hits), bool)
        new[1:] = np.diff(hits) > 1
        run = hits[new][np.cumsum(new) - 1]
        at = hits[(hits - run) % 2 == 0]
        owner = np.searchsorted(first, at, "right") - 1
        several = np.flatnonzero(np.bincount(owner, minlength=len(first))[owner] > 1)
        if not len(several):
            return at
        # would one of several merges make a pair that comes before the others, or ties with them?
        a, own = at[several], owner[several]
        inside = a > first[own]
        before = symbols[np.maximum(a - 1, 0)]
        joined = np.zeros(len(a), bool)
        joined[1:] = a[1:] - a[:-1] == 2
        before[joined] = made[a[np.flatnonzero(joined) - 1]]
        after_at = a + 2
        follows = after_at < first[own] + sizes[own]
        after = symbols[np.minimum(after_at, len(symbols) - 1)]
        sooner = inside & (self.ranks(self.merged(before, made[a])) <= least[own])
        sooner |= follows & (self.ranks(self.merged(made[a], after)) <= least[own])
        if not sooner.any():
            return at
        careful = np.zeros(len(first), bool)
        careful[own[sooner]] = True
        leftmost = np.ones(len(at), bool)
        leftmost[1:] = owner[1:] != owner[:-1]
        return at[leftmost | ~careful[owner]]

    def _with_bytes(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        bare = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(bare):
            return symbols, sizes
        held = symbols[bare].astype(np.int64)
        points = -1 - held
        inner = held >= 0
        points[inner] = self.extra[held[inner] - self.size]
        width = np.ones(len(symbols), np.int64)
        width[bare] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        out = np.repeat(symbols, width)
        spread = np.zeros(len(symbols), bool)
        spread[bare] = True
        out[np.repeat(spread, width)] = self.bytes[np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)]
        ends = np.concatenate(([0], np.cumsum(width)))[np.cumsum(sizes)]
        return out, np.diff(ends, prepend=0)


class PieceEncoder(Encoder):
    """Ids of texts, with a table of known words that grows with use."""

    def __init__(self, model: str) -> None:
        self.vocabulary, self.special = Vocabulary(model), []
        self._reset()

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        parts, at, size = [], 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t)
            if size >= _GROUP or i == len(texts):
                parts.append(self.vocabulary.encode_words([x.replace(" ", MARK) for x in texts[at:i]]))
                at, size = i, 0
        flat, sizes = (np.concatenate(x) for x in zip(*parts))
        n, most = self.table.n, self.table.n + len(texts)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while most > len(self.size):
            self.place, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.place, self.size))
        self.place[n:most], self.size[n:most] = self.used + np.cumsum(sizes) - sizes, sizes
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.table.put(hashes, np.arange(n, most))

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if self.used > MOST_IDS:
            self._reset()
        return super()._entries(data, starts, ends, hashes)

    def _split(self, column: pa.ChunkedArray) -> tuple:
        """Words of the normalised texts, with a blank for each word mark."""
        column = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), MARK, " ")
        lead, glue = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(lead, column, glue))
        data, offsets = text_bytes(texts)
        blank = data == 0x20
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.vocabulary.period and len(data):
            # long runs of blanks are cut where their pieces repeat
            runs = np.flatnonzero(new)
            stop = np.flatnonzero(~blank)
            end = np.append(stop, len(data))[np.searchsorted(stop, runs)]
            end = np.minimum(end, np.append(runs[1:], len(data)))
            cuts = (end - runs - 1) // self.vocabulary.period
            long = np.flatnonzero(cuts)
            step = np.arange(cuts[long].sum()) - np.repeat(np.cumsum(cuts[long]) - cuts[long], cuts[long]) + 1
            new[np.repeat(runs[long], cuts[long]) + step * self.vocabulary.period] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        return data, offsets, starts, np.searchsorted(starts, offsets), ends, hashes


@lru_cache(2)
def piece_encoder(model: str) -> PieceEncoder:
    """The encoder of a worker process; its table lives from task to task."""
    return PieceEncoder(model)


def _decoded(model: str, lists: list[list[int]]) -> list[str]:
    return piece_encoder(model).vocabulary.library.decode(lists, num_threads=1) if lists else []


def encode_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                  decoded: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` and ``rest``, a struct of its columns; with ``decoded`` also
    the text that the ids stand for."""
    path = model or default_model()
    rows = frames.packed(docs, id_col, text_col)

    def encode(table: pa.Table) -> pa.Table:
        ids, bounds = piece_encoder(path).encode(table["text"])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
        out = {"doc_id": table["doc_id"], "ids": lists}
        if decoded:
            out["decoded"] = pa.array(_decoded(path, lists.to_pylist()), pa.string())
        return pa.table(out | {"rest": table["rest"]})

    columns = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return map_slabs(rows, encode, frames.with_rest(columns, rows))


def decode_pieces(encoded: DataFrame, *, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of the ids; null or no ids give an empty text."""
    path = model or default_model()
    rows = encoded.select(F.col(f"`{ids_col}`").cast("array<int>").alias("ids"),
                          F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("rest"))
    frames.small_batches(encoded.sparkSession)

    def decode(batches):
        for batch in batches:
            texts = _decoded(path, [x or [] for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["decoded", "rest"])

    found = rows.mapInArrow(decode, frames.with_rest("decoded string", rows))
    return found.select(*[F.col(f"rest.`{c}`") for c in encoded.columns if c != "decoded"], "decoded")


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    found = encode_pieces(frames.documents(spark, folder).select("doc_id", "text"), decoded=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
