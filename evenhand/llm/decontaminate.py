"""Benchmark decontamination by suffix arrays of the training text.

Every task builds suffix arrays over shards of its documents (some megabytes of text, or one
longer document) and binary-searches every suffix of the test items in each. That gives the
longest verbatim match of each test suffix in each shard with its place, and all occurrences
of each window of ``window`` words. An item of fewer words, but not none, is one window.
Occurrences of consecutive windows at consecutive places are one match; each document is given the
longest of its own, with its item and both places. Words are compared by 64-bit hashes.

Documents are not shuffled. The test set is broadcast in parts of at most ``ITEM_BYTES`` of
text; a larger one takes a pass for each part, and what earlier passes found is carried along
with the documents.

Nulls have no words. Rows that share an id are judged each for itself; an item id that is null
is listed as the empty string, item rows that share an id count as one item. Of matches equally long the
one of the least item id counts, then the first in the item, then in the document. Without items
nothing is hit, without documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import stage
from . import frames
from .suffix_array import SuffixArray
from .words import ALNUM, Words, map_slabs, pack, text_bytes, unpack

WINDOW = 13
ITEM_BYTES = 4 << 20


class Items:
    """Test items as one sequence of word hashes: of each word its item, the start and end of the item,
    and the length of the window that begins there (0: none)."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        w = Words(*text_bytes(pa.array(texts, pa.string())), ALNUM)
        self.hashes = w.hashes(lower=True)
        self.names = np.array(sorted(set(ids)), dtype=object)
        self.item = np.searchsorted(self.names, np.array(ids, dtype=object))[w.documents()] if w.n else np.empty(0, int)
        self.starts, self.ends = np.repeat(w.first[:-1], w.counts), np.repeat(w.first[1:], w.counts)
        size = np.minimum(np.repeat(w.counts, w.counts), window)
        self.marks = np.where(np.arange(w.n) + size <= self.ends, size, 0)
        self.longest = int(w.counts.max(initial=0))


def _parts(spark: SparkSession, items: DataFrame, window: int) -> list[Callable[[], Broadcast]]:
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string"))
    parts = max(1, -(-frames.text_total(rows) // ITEM_BYTES))

    def part(k: int) -> Callable[[], Broadcast]:
        def load() -> Broadcast:
            mine = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
            return spark.sparkContext.broadcast(Items([r[0] for r in mine], [r[1] for r in mine], window))
        return load

    return [part(k) for k in range(parts)]


def _shard(table: pa.Table, items: Items) -> tuple[Words, SuffixArray]:
    w = Words(*text_bytes(table["text"]), ALNUM)
    return w, SuffixArray(w.hashes(lower=True), w.counts, items.longest)


def _hits(w: Words, array: SuffixArray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Which words are hit; the pairs (document, item) with occurring windows; of each document with any the
    longest match as (document, words, item, its start in the item, in the document)."""
    low, high, _, _ = array.search(items.hashes, items.ends, items.marks)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = array.order[np.repeat(low[found], counts) + within]
    test = np.repeat(found, counts)
    doc = np.searchsorted(array.starts, at, "right") - 1
    word = at - doc
    change = np.zeros(w.n + 1, np.int32)
    np.add.at(change, word, 1)
    np.add.at(change, word + items.marks[test], -1)
    pairs = np.unique(np.stack([doc, items.item[test]]), axis=1)
    return np.cumsum(change[:-1]) > 0, pairs[0], pairs[1], _longest(w, items, doc, word, test)


def _longest(w: Words, items: Items, doc: np.ndarray, word: np.ndarray, test: np.ndarray) -> list[tuple]:
    """The longest match of each document, out of the places of windows in documents and in items."""
    by = np.lexsort((word, word - test))
    doc, word, test = doc[by], word[by], test[by]
    new = np.ones(len(doc), bool)
    new[1:] = ((word[1:] - test[1:] != word[:-1] - test[:-1]) | (word[1:] != word[:-1] + 1) | (doc[1:] != doc[:-1])
               | (items.starts[test[1:]] != items.starts[test[:-1]]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(doc))) + items.marks[test[first]] - 1
    doc, word, test = doc[first], word[first] - w.first[doc[first]], test[first]
    start = test - items.starts[test]
    by = np.lexsort((word, start, items.item[test], -size, doc))
    best = by[np.flatnonzero(np.diff(doc[by], prepend=-1))]
    return list(zip(doc[best].tolist(), size[best].tolist(), items.names[items.item[test[best]]], start[best].tolist(), word[best].tolist()))


MATCH = T.StructType().add("n_words", "long").add("item_id", "string").add("item_start", "long").add("doc_start", "long")


def _better(a: dict | None, b: dict | None) -> dict | None:
    """The longer of two matches."""
    both = [m for m in (a, b) if m]
    return min(both, key=lambda m: (-m["n_words"], m["item_id"], m["item_start"], m["doc_start"]), default=None)


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit`` (words in a window of an item),
    ``item_ids`` (sorted), ``longest``, a struct of its longest match with a window (``n_words``, ``item_id`` and where
    the match starts in both, in words from 0; null without any), and ``rest``, a struct of all its columns."""
    rows = frames.packed(docs, id_col, text_col).withColumns(
        {"hit": F.lit(None).cast("binary"), "item_ids": F.lit(None).cast("array<string>"),
         "longest": F.lit(None).cast(MATCH)})
    schema = rows.schema
    parts = _parts(docs.sparkSession, items, window)
    for k, load in enumerate(parts):
        held = load()

        def judge(table: pa.Table, held: Broadcast = held) -> pa.Table:
            own = held.value
            w, array = _shard(table, own)
            hit, doc, item, matches = _hits(w, array, own)
            longest = table["longest"].to_pylist()
            for d, *match in matches:
                longest[d] = _better(longest[d], dict(zip(MATCH.names, match)))
            names: list[list[str]] = [list(x) if x else [] for x in table["item_ids"].to_pylist()]
            for d, i in zip(doc.tolist(), own.names[item]):
                names[d].append(i)
            old, blobs = table["hit"].to_pylist(), []
            for d in range(len(names)):
                mine = np.flatnonzero(hit[w.first[d]:w.first[d + 1]]) if names[d] else np.empty(0, np.int64)
                if old[d]:
                    mine = np.union1d(mine, unpack(old[d])[0])
                blobs.append(pack(mine) if len(mine) else None)
            return table.set_column(3, "hit", pa.array(blobs, pa.binary())).set_column(
                4, "item_ids", pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))).set_column(
                5, "longest", pa.array(longest, to_arrow_type(MATCH)))

        if k + 1 < len(parts):
            rows = stage(map_slabs(rows, judge, schema), f"items-{k}")
            held.destroy()
        else:
            def final(table: pa.Table, judge: Callable = judge) -> pa.Table:
                table = judge(table)
                words = Words(*text_bytes(table["text"]), ALNUM).counts
                n = [len(unpack(b)[0]) if b else 0 for b in table["hit"].to_pylist()]
                return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(words, pa.int64()), "n_hit": pa.array(n, pa.int64()),
                                 "item_ids": table["item_ids"], "longest": table["longest"], "rest": table["rest"]})

            rows = map_slabs(rows, final, frames.with_rest(
                f"doc_id long, n_words long, n_hit long, item_ids array<string>, longest {MATCH.simpleString()}", rows))
    return rows


def longest_matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW, least: int = WINDOW) -> DataFrame:
    """The longest verbatim match of each test suffix in each shard, where it has ``least`` words:
    ``item_id``, ``item_start``, ``doc_id``, ``doc_start`` (words from 0), ``n_words``. Suffixes whose
    match only continues that of the suffix before are left out. One row set per part of the items."""
    rows = frames.packed(docs, id_col, text_col).drop("rest")
    out = None
    for load in _parts(docs.sparkSession, items, window):
        held = load()

        def match(table: pa.Table, held: Broadcast = held) -> pa.Table:
            own = held.value
            _, array = _shard(table, own)
            _, _, longest, where = array.search(own.hashes, own.ends, own.marks)
            first = np.concatenate(([0], np.flatnonzero(own.ends[1:] != own.ends[:-1]) + 1))
            new = np.ones(len(longest), bool)
            new[1:] = longest[1:] != longest[:-1] - 1
            new[first[first < len(new)]] = True
            at = np.flatnonzero((longest >= least) & new)
            doc = np.searchsorted(array.starts, where[at], "right") - 1
            start = first[np.searchsorted(first, at, "right") - 1]
            return pa.table({"item_id": pa.array(own.names[own.item[at]], pa.string()), "item_start": pa.array(at - start, pa.int64()),
                             "doc_id": table["doc_id"].take(pa.array(doc)), "doc_start": pa.array(where[at] - array.starts[doc], pa.int64()),
                             "n_words": pa.array(longest[at], pa.int64())})

        found = map_slabs(rows, match, "item_id string, item_start long, doc_id long, doc_start long, n_words long")
        out = found if out is None else out.union(found)
    return out


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    judged = contamination(frames.documents(spark, folder).select("doc_id", "text"), frames.documents(spark, folder, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("longest.n_words", F.lit(0)).alias("longest_words"), F.col("longest.item_id").alias("longest_item"),
        F.col("longest.item_start").alias("item_start"), F.col("longest.doc_start").alias("doc_start"))
