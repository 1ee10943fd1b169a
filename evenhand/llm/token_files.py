"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, an end id after each, in blocks of 256. From a
block its minimum is subtracted; the differences are packed at the width of their
``percentile``, and those that need more bits leave their high bits in an exception list.

A file is a row of segments and their index. A segment, little-endian: magic ``EHPF``, then as
64-bit numbers documents, ids, blocks and
exceptions; the documents' ids (64 bits; the least number stands for null) and lengths (64);
the index of the blocks: minimum (32), width (8), start of the packed bits (64), start of the
exceptions (64); the packed bits; the exceptions' places in their blocks (8) and high bits (32).
The last block is filled up with its last id. The file's index has for each segment its place, size,
documents and ids (64 each), then the number of segments (64) and the magic ``EHPX``.

Documents are dealt by ranges of their ids and sorted, so that files in name order hold them in
ascending order; rows that share an id lie in the order of a hash of their texts, by which they may be in
several ranges, and of the texts; null ids come first.
A task writes one file, a segment for each slab of text, under a name of its own that it renames at the end, so
a repeated task leaves the same files. Segments are read back by tasks out of the list that writing
gives; no folder is listed. A null text is empty: the
end id alone. Without documents there are no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import with_total_before
from ..staging import new_folder, stage
from . import frames
from .tokens import default_vocabulary, encoder
from .words import SLAB_BYTES, release, slabs

BLOCK = 256
END = 2
PERCENTILE = 98
FILE_BYTES = 256 << 20
READ_BYTES = 16 << 20
_MAGIC, _INDEX_MAGIC = b"EHPF", b"EHPX"
_SEGMENT = np.dtype([("at", "<i8"), ("size", "<i8"), ("n_docs", "<i8"), ("n_ids", "<i8")])
_INDEX = np.dtype([("low", "<u4"), ("width", "u1"), ("bits", "<u8"), ("patches", "<u8")])


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 numbers below 2**width as rows of 4 * width 64-bit words."""
    out = np.zeros((len(values), 4 * width), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = v & mask
    return out


def write_ids(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The bytes of a segment."""
    blocks = -(-len(ids) // BLOCK)
    rows = np.pad(ids, (0, blocks * BLOCK - len(ids)), mode="edge").reshape(blocks, BLOCK).astype(np.uint32) if blocks else np.zeros((0, BLOCK), np.uint32)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rows = rows - low[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    limit = np.partition(rows, rank, axis=1)[:, rank] if blocks else low
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    index = np.zeros(blocks, _INDEX)
    index["low"], index["width"] = low, width
    index["bits"] = np.cumsum(width * 4) - width * 4
    over = rows >> width[:, None].astype(np.uint32)
    block, place = np.nonzero(over)
    index["patches"] = np.searchsorted(block, np.arange(blocks))
    packed = np.zeros(int(width.sum() * 4), np.uint64)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            body = _packed((rows[mine] & np.uint32((1 << int(w)) - 1)).astype(np.uint64), int(w))
            packed[(index["bits"][mine].astype(np.int64)[:, None] + np.arange(4 * w))] = body
    head = np.array([len(doc_ids), len(ids), blocks, len(block)], "<i8")
    return b"".join([_MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), index.tobytes(),
                     packed.astype("<u8").tobytes(), place.astype(np.uint8).tobytes(), over[block, place].astype("<u4").tobytes()])


class Segment:
    """A segment's documents, and its ids as a whole or block by block."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != _MAGIC:
            raise ValueError("not a segment of token ids")
        docs, self.n, self.blocks, patches = np.frombuffer(raw, "<i8", 4, 4).tolist()
        at = 36
        self.doc_ids, self.lengths = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        self.index = np.frombuffer(raw, _INDEX, self.blocks, at)
        at += _INDEX.itemsize * self.blocks
        words = int(self.index["width"].astype(np.int64).sum() * 4)
        self.bits = np.frombuffer(raw, "<u8", words, at)
        at += 8 * words
        self.places, self.high = np.frombuffer(raw, np.uint8, patches, at), np.frombuffer(raw, "<u4", patches, at + patches)

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the blocks from ``first`` up to ``last``, found by the index."""
        last = self.blocks if last is None else last
        index = self.index[first:last]
        out, width = np.zeros((len(index), BLOCK), np.uint32), index["width"].astype(np.int64)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            out[mine] = _unpacked(self.bits[index["bits"][mine].astype(np.int64)[:, None] + np.arange(4 * w)], int(w))
        starts = np.append(self.index["patches"], len(self.places)).astype(np.int64)
        a, b = (starts[first], starts[last]) if len(index) else (0, 0)
        block = np.searchsorted(starts[first:last + 1], np.arange(a, b), "right") - 1
        out[block, self.places[a:b]] |= self.high[a:b] << width[block].astype(np.uint32)
        return (out + index["low"][:, None]).ravel()[:self.n - first * BLOCK]


def segments(file: pa.NativeFile) -> np.ndarray:
    """The index of a file: ``at``, ``size``, ``n_docs`` and ``n_ids`` of its segments."""
    size = file.size()
    tail = file.read_at(12, size - 12)
    if tail[8:] != _INDEX_MAGIC:
        raise ValueError("not a file of token ids")
    n = int.from_bytes(tail[:8], "little") * _SEGMENT.itemsize
    return np.frombuffer(file.read_at(n, size - 12 - n), _SEGMENT)


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END,
                      vocabulary: str | None = None, file_bytes: int = FILE_BYTES, segment_bytes: int = SLAB_BYTES) -> DataFrame:
    """Writes a file for each range of about ``file_bytes`` of text, of which there are 32 at least, and returns the list
    of segments: ``file``, ``part``, ``segment``, ``at``, ``size``, ``n_docs``, ``n_ids``."""
    frames.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = frames.packed(docs, id_col, text_col).drop("rest")
    parts = max(32, -(-frames.text_total(rows) // file_bytes))
    spread = rows.withColumn("print", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "print").sortWithinPartitions(
        "doc_id", "print", "text").drop("print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:08d}.ids"
        out, index = None, []
        for slab in slabs(batches, most=segment_bytes):
            if out is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                draft = f"{base}/_{name}.{uuid.uuid4().hex}"
                out = store.open_output_stream(draft)
            ids, bounds = encoder(path).encode(slab["text"])
            raw = write_ids(slab["doc_id"].fill_null(-(2**63)).to_numpy(), np.diff(bounds) + 1, np.insert(ids, bounds[1:], end))
            at = sum(index[-1][:2]) if index else 0
            index.append((at, len(raw), len(bounds) - 1, len(ids) + len(bounds) - 1))
            out.write(raw)
        if out is not None:
            held = np.array(index, _SEGMENT)
            out.write(held.tobytes() + len(held).to_bytes(8, "little") + _INDEX_MAGIC)
            out.close()
            store.move(draft, f"{base}/{name}")
            yield pa.record_batch([pa.array([name] * len(held)), pa.array([part] * len(held), pa.int64()), pa.array(range(len(held)), pa.int64()),
                                   *[pa.array(held[c].copy(), pa.int64()) for c in _SEGMENT.names]],
                                  names=["file", "part", "segment", *_SEGMENT.names])
        release()

    return stage(spread.mapInArrow(run, "file string, part long, segment long, at long, size long, n_docs long, n_ids long"), "token-files")


def read_token_files(folder: str, listed: DataFrame) -> DataFrame:
    """The documents in the listed segments: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32``."""
    tasks = max(32, -(-(listed.agg(F.sum("size")).first()[0] or 0) // READ_BYTES))
    based = with_total_before(listed, ("part", "segment"), "n_ids", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as file:
                    own = Segment(file.read_at(row["size"], row["at"]))
                ids, ends = own.read().astype("<u4"), np.cumsum(own.lengths)
                starts = ends - own.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(own.doc_ids, pa.int64(), mask=own.doc_ids == -(2**63)), pa.array(starts + row["base"], pa.int64()),
                                       pa.array(own.lengths, pa.int64()), pa.array(crc, pa.int64())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])
        release()

    return based.select("file", "at", "size", "base").repartition(tasks, "file", "at").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    where = new_folder(spark, "ids")
    listed = write_token_files(frames.documents(spark, folder).select("doc_id", "text"), where)
    return read_token_files(where, listed)
