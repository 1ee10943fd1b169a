"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

First tier: a broadcast hash table of the lengths, in tokens, of at most ``FREQUENT`` pre-tokens, the
most frequent ones of a sample of documents whose text has ``SAMPLE_BYTES`` bytes as expected, however large the
corpus. Tasks name the pre-tokens of their part of the sample with counts; what they name is no more
than the sample and is added up on the driver. Second tier: a table that every worker process fills
with the pre-tokens it met and the library encoded. The first tier only saves work; counts are those of
the library whatever it holds. So the texts of the corpus are split into pre-tokens once, by the tasks that
read them, and no step shuffles.

A null is an empty text. Rows that share an id, or repeat, are counted each for itself. Ties in frequency go to
the lesser pre-token. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .tokens import HashTable, default_vocabulary, encoder, pre_tokens
from .words import map_slabs, span_hashes, text_bytes

FREQUENT = 1 << 15
SAMPLE_BYTES = 8 << 20
LIMIT = 512


def frequent_lengths(docs: DataFrame, vocabulary: str, size: int = FREQUENT) -> Broadcast:
    """The broadcast first tier: at most ``size`` entries of 12 bytes in a half-empty table."""

    def named(table: pa.Table) -> pa.Table:
        data, offsets = text_bytes(table["text"])
        starts, _ = pre_tokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        _, first, counts = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
        found = [data[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        return pa.table({"word": pa.array(found, pa.string()), "n": pa.array(counts, pa.int64())})

    share = min(1.0, SAMPLE_BYTES / max(1, frames.text_total(docs)))
    drawn = map_slabs(docs.select("text").sample(share, seed=1), named, "word string, n long").toArrow()
    most = drawn.group_by("word").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("word", "ascending")])
    words = most.slice(0, size)["word"].to_pylist()
    data, offsets = text_bytes(pa.array(words, pa.string()))
    hashes = span_hashes(data, offsets[:-1], offsets[1:])
    hashes[hashes == 0] = 1
    found = HashTable(int(2 * len(words) + 2).bit_length())
    _, at = np.unique(hashes, return_index=True)
    encodings = encoder(vocabulary).library.encode_batch_fast(words, add_special_tokens=False)
    found.put(hashes[at], np.array([len(e.ids) for e in encodings], np.int64)[at])
    return docs.sparkSession.sparkContext.broadcast(found)


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``rest``, a struct of its columns."""
    path = vocabulary or default_vocabulary()
    rows = frames.packed(docs, id_col, text_col)
    tier = frequent_lengths(rows, path, frequent)

    def count(table: pa.Table) -> pa.Table:
        n_bytes, n_tokens = encoder(path).count(table["text"], tier.value)
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()),
                         "n_tokens": pa.array(n_tokens, pa.int64()), "rest": table["rest"]})

    return map_slabs(rows, count, frames.with_rest("doc_id long, n_bytes long, n_tokens long", rows))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(frames.documents(spark, folder).select("doc_id", "text"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
