"""Quality rules on repetition, by suffix arrays.

For a slab of documents one suffix array is built in which words of different documents differ.
Neighbours in its order with a common prefix of k words delimit an interval of suffixes that
repeat; so the longest repeat that starts at a word is the longer of the common prefixes with
its two neighbours. Repeats of at least ``LEAST`` words are spans, taken to their full length;
their union is the covered part of a text. A document is kept if it does not fail the base
rules, at most ``MOST_COVERED`` hundredths of its words are covered, and its longest repeat has at
most ``MOST_REPEAT`` words.

Base rules: fewer than ``LEAST_WORDS`` words, or more than ``MOST_WINDOWED`` hundredths of them in
windows of ``WINDOW`` words that are found twice or more. Nulls and texts without words fail.
Rows that share an id are judged each for itself. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import frames
from .suffix_array import SuffixArray
from .words import SPACED, Words, map_slabs, mix, span_hashes, text_bytes

WINDOW = 8
LEAST = 4
LEAST_WORDS = 20
MOST_WINDOWED = 30
MOST_COVERED = 30
MOST_REPEAT = 50
SLAB = 3 << 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeats(w: Words) -> np.ndarray:
    """The words of the longest repeat, in the same document, that starts at each word."""
    salt = mix(np.arange(len(w.counts), dtype=np.uint64) + np.uint64(1))
    array = SuffixArray(mix(w.hashes() ^ salt[w.documents()]), w.counts, int(w.counts.max(initial=0)), prefixes=True)
    common = array.common()
    longest = np.maximum(common, np.append(common[1:], 0))
    doc = np.searchsorted(array.starts, array.order, "right") - 1
    out = np.zeros(w.n, np.int64)
    out[array.order - doc] = longest
    return out


def covered(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def duplicate_lines(w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    breaks = np.flatnonzero(w.data == 0x0A)
    starts = np.union1d(w.offsets[:-1], breaks + 1)
    ends = np.append(starts[1:], len(w.data))
    ends = ends - ((ends > starts) & (w.data[np.maximum(ends - 1, 0)] == 0x0A)) if len(w.data) else ends
    with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[with_word], ends[with_word]
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    salt = mix(np.arange(len(w.counts), dtype=np.uint64) + np.uint64(1))
    _, first = np.unique(mix(span_hashes(w.data, starts, ends) ^ salt[doc]), return_index=True)
    lines = np.bincount(doc, minlength=len(w.counts))
    return lines - np.bincount(doc[first], minlength=len(w.counts))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  most_covered: int = MOST_COVERED, most_repeat: int = MOST_REPEAT) -> DataFrame:
    """One row per document: ``doc_id``, the counts of the base rules, ``base_failed``, ``n_covered``
    (words in repeats), ``longest_repeat`` (words), ``kept`` and ``rest``, a struct of its columns."""
    rows = frames.packed(docs, id_col, text_col)

    def judge(table: pa.Table) -> pa.Table:
        w = Words(*text_bytes(table["text"]), SPACED)
        longest = repeats(w)
        windowed = np.flatnonzero(longest >= WINDOW)
        long_ = np.flatnonzero(longest >= least)
        n = w.counts
        n_repeat = _sums(covered(w.n, windowed, np.full(len(windowed), WINDOW)), w.first)
        n_covered = _sums(covered(w.n, long_, longest[long_]), w.first)
        most = np.zeros(len(n), np.int64)
        if w.n:
            most[n > 0] = np.maximum.reduceat(longest, w.first[:-1][n > 0])
        inside = np.zeros(len(w.data) + 1, np.int64)
        inside[w.starts] = 1
        inside[w.ends] -= 1
        chars = (np.cumsum(inside[:-1]) > 0) & ((w.data & 0xC0) != 0x80)
        failed = (n < LEAST_WORDS) | (100 * n_repeat > MOST_WINDOWED * n)
        kept = ~failed & (100 * n_covered <= most_covered * n) & (most <= most_repeat)
        columns = {"n_words": n, "word_chars": _sums(chars, w.offsets), "n_symbols": _sums(_SYMBOLS[w.data], w.offsets),
                   "n_dup_lines": duplicate_lines(w), "n_repeat_words": n_repeat}
        return pa.table({"doc_id": table["doc_id"]} | {k: pa.array(v, pa.int64()) for k, v in columns.items()} | {
            "base_failed": pa.array(failed), "n_covered": pa.array(n_covered, pa.int64()),
            "longest_repeat": pa.array(most, pa.int64()), "kept": pa.array(kept), "rest": table["rest"]})

    return map_slabs(rows, judge, frames.with_rest(
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, n_covered long, longest_repeat long, kept boolean", rows), most=SLAB)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(frames.documents(spark, folder).select("doc_id", "text")).drop("rest")
