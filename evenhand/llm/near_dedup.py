"""Near-duplicates by SetSketch registers.

A document's set is that of its distinct shingles of ``shingle`` words, A-Z lower-cased; with
fewer words the whole sequence is one. Documents whose sets have a Jaccard similarity of
``percent`` hundredths or more are linked; a component is what links connect.

1. Each document gets the size and a 128-bit fingerprint of its set, and ``ROWS`` registers
   for each band: the least of its elements' exponentially distributed hashes, on a scale spaced
   exponentially with base ``BASE`` and truncated to 16 bits. Registers of a union are the
   maxima of registers, so sketches merge.
2. Documents with equal sets are one class, whose least id stands for it. Only classes go on,
   so thousands of copies are one row.
3. Register values are banded. Classes that share a band are compared: with the sizes known,
   the counts of registers that are greater, less and equal have a likelihood for each
   similarity, whose maximum is the joint estimate. Pairs estimated over ``KEEP`` below the
   threshold form candidate groups; of each band only links to the least class are kept.
4. Within a candidate group all pairs are verified on full sets, by products of incidence
   matrices; of the links found those to the least class of each part are kept.
5. Components of these links, then of all documents.

Two sets at the threshold share none of the bands of 5 with a probability of at most ``MISS``: 24
bands at 0.85 (7.7e-7; two sets at 0.9: 5e-10), 36 at 0.80 (6.2e-7). They are estimated 0.2 too low with one of about 1e-9; nothing else is lost. Groups of
more than ``TILE`` classes are dealt into tiles, a task for each pair of tiles, so that no task
holds a group and no pair is put out. Links and components stay in tables.

Nulls and texts without words have an empty set and are linked with nothing. Rows that share an
id are one document, which has the links of each. A row whose id is null stands for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage
from . import frames
from .components import connected, labels
from .words import SPACED, Words, map_slabs, mix, pack, release, text_bytes, unpack, window_hashes

SHINGLE = 5
PERCENT = 85
ROWS = 5
MISS = 8e-7
BASE, RATE = 1.001, 20.0
KEEP = 0.2
TILE = 512
_HASH_BITS = 51
_TEXTS = 1 << 64 - _HASH_BITS


def registers_for(percent: int) -> int:
    """How many registers have bands enough that sets at the threshold miss all with ``MISS`` at most."""
    apart = 1 - (percent / 100) ** ROWS
    return ROWS * max(1, math.ceil(math.log(MISS) / math.log(apart))) if apart > 0 else ROWS


def shingles(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending 51-bit hashes, one text after the other,
    and where each text's start (one more entry at the end)."""
    w = Words(*text_bytes(table["text"]), SPACED)
    hashes, docs = w.hashes(lower=True), len(w.counts)
    at = w.windows(size)
    keys, doc = window_hashes(hashes, at, size), np.searchsorted(w.first, at, "right") - 1
    for n in range(1, size):
        short = np.flatnonzero(w.counts == n)
        keys = np.concatenate([keys, window_hashes(hashes, w.first[short], n) + np.uint64(n)])
        doc = np.concatenate([doc, short])
    parts, sizes = [], []
    for base in range(0, docs, _TEXTS):
        mine = slice(None) if docs <= _TEXTS else (doc >= base) & (doc < base + _TEXTS)
        # a text's number above its hash: one sort of plain numbers orders all texts' sets
        both = np.sort(((doc[mine] - base).astype(np.uint64) << np.uint64(_HASH_BITS)) | (keys[mine] >> np.uint64(64 - _HASH_BITS)))
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        first = np.searchsorted(both, np.arange(min(_TEXTS, docs - base), dtype=np.uint64) << np.uint64(_HASH_BITS))
        parts.append(both & np.uint64((1 << _HASH_BITS) - 1))
        sizes.append(np.diff(first, append=len(both)))
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))])


def registers(elements: np.ndarray, first: np.ndarray, count: int = registers_for(PERCENT)) -> np.ndarray:
    """The ``count`` registers of each non-empty set, 16 bits each."""
    sets = len(first) - 1
    factors = np.random.default_rng(7).integers(1, 2**31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.empty((count, sets), np.uint32)
    low = mix(elements).astype(np.uint32)
    at = 0
    while at < sets:
        to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 16), "right")) - 1)
        part, starts = low[first[at]:first[to]], first[at:to] - first[at]
        turned = np.empty_like(part)
        for j, factor in enumerate(factors):
            np.multiply(part, factor, out=turned)
            least[j, at:to] = np.minimum.reduceat(turned, starts)
        at = to
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def sketches(rows: DataFrame, size: int, registers_each: int) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``f1``, ``f2`` (fingerprint) and ``registers``."""

    def sketch(table: pa.Table) -> pa.Table:
        elements, first = shingles(table, size)
        n = np.diff(first)
        full = np.flatnonzero(n > 0)
        prints = []
        for salt in (1, 2):
            total = np.zeros(len(elements) + 1, np.uint64)
            np.cumsum(mix(elements, 0x9E3779B97F4A7C15 * salt % 2**64), out=total[1:])
            prints.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        own = registers(elements, np.append(first[full], len(elements)), registers_each) if len(full) else np.empty((0, registers_each), np.uint16)
        blobs: list[bytes | None] = [None] * len(n)
        for d, values in zip(full.tolist(), own):
            blobs[d] = values.tobytes()
        return pa.table({"doc_id": table["doc_id"], "n": pa.array(n, pa.int64()), "f1": pa.array(prints[0]),
                         "f2": pa.array(prints[1]), "registers": pa.array(blobs, pa.binary())})

    return map_slabs(rows.select("doc_id", "text"), sketch, "doc_id long, n long, f1 long, f2 long, registers binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def banded(classes: DataFrame) -> DataFrame:
    """A row for each class and band: ``band`` (a hash of the band's number and registers), ``node``."""

    def split(table: pa.Table) -> pa.Table:
        own = _matrix(table["registers"])
        bands = own.shape[1] // ROWS
        parts = own.reshape(-1, bands, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for r in range(ROWS):
            key = mix(key + parts[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
        return pa.table({"band": pa.array(key.ravel().view(np.int64)), "node": pa.array(np.repeat(table["node"].to_numpy(), bands))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from split(pa.Table.from_batches([batch])).to_batches()

    return classes.select("node", "registers").mapInArrow(run, "band long, node long")


def similarity(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
               count: int = registers_for(PERCENT)) -> np.ndarray:
    """The similarity of the greatest likelihood, given how many of ``count`` registers of a are
    more and less than those of b, and the sizes of the sets."""
    u = n_a / (n_a + n_b)
    most = np.minimum(u / (1 - u), (1 - u) / u)
    best, score = np.zeros(len(u)), np.full(len(u), -np.inf)
    chance = lambda x: np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    for j in np.linspace(0, 1, 41):
        s = np.minimum(j, most)
        p, q = chance(u - (1 - u) * s), chance((1 - u) - u * s)
        now = more * np.log(p) + less * np.log(q) + (count - more - less) * np.log(np.maximum(1 - p - q, 1e-12))
        better = now > score
        best[better], score[better] = s[better], now[better]
    return best


def tiled(rows: DataFrame, count: Column, tile: int) -> DataFrame:
    """Groups of more than ``tile`` rows dealt into tiles; a row goes with each other tile once:
    ``i`` and ``j`` name the pair of tiles, ``side`` the row's own."""
    tiles = F.ceil(count / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    return rows.withColumn("tiles", tiles).withColumn("side", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn(
        "i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("tiles", "other")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come sorted by ``keys``: tables and where their groups start."""
    held: pa.Table | None = None

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            values = table[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        starts = cut(table)
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _pairs(starts: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, in parts of about ``most``."""
    for size in np.unique(np.diff(starts)):
        own = starts[:-1][np.diff(starts) == size]
        a, b = np.triu_indices(size, 1)
        step = max(1, most // max(1, len(a)))
        for k in range(0, len(own), step):
            base = own[k:k + step, None]
            left, right = (base + a).ravel(), (base + b).ravel()
            for at in range(0, len(left), most):
                yield left[at:at + most], right[at:at + most]


def _links(table: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links of each node with the least one that the pairs connect it with."""
    nodes, place = np.unique(table["node"].to_numpy(), return_inverse=True)
    least = labels(len(nodes), place[a], place[b])
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return pa.record_batch([pa.array(nodes[least[other]]), pa.array(nodes[other])], names=["a", "b"])


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect classes which share a band and may be similar enough."""
    bands = banded(classes)
    shared = stage(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    rows = tiled(bands.join(shared, "band"), F.col("size"), TILE).drop("size")
    rows = rows.join(classes.select("node", "n", "registers"), "node")
    least = percent / 100 - KEEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["band", "i", "j"]):
            own, n = _matrix(table["registers"]), table["n"].to_numpy().astype(np.float64)
            side, across = table["side"].to_numpy(), (table["i"].to_numpy() != table["j"].to_numpy())
            found_a, found_b = [], []
            for a, b in _pairs(starts):
                use = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent) & (~across[a] | (side[a] != side[b]))
                a, b = a[use], b[use]
                for at in range(0, len(a), 1 << 13):
                    x, y = a[at:at + (1 << 13)], b[at:at + (1 << 13)]
                    more = np.count_nonzero(own[x] > own[y], axis=1)
                    less = np.count_nonzero(own[x] < own[y], axis=1)
                    good = similarity(more, less, n[x], n[y], own.shape[1]) >= least
                    found_a.append(x[good])
                    found_b.append(y[good])
            if found_a:
                yield _links(table, np.concatenate(found_a), np.concatenate(found_b))
        release()

    spread = rows.select("band", "i", "j", "side", "node", "n", "registers").repartition("band", "i", "j")
    return spread.sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long")


def _verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``) of sets that are similar enough."""
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    element = np.cumsum(new) - 1
    common = np.bincount(element)[element] > 1  # an element of one set is in no intersection
    element, owner = np.unique(element[common], return_inverse=True)[1], owner[common]
    row = np.full(len(sets), -1)
    row[left] = np.arange(len(left))
    column = np.full(len(sets), -1)
    column[right] = np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    bounds = np.searchsorted(element, np.arange(0, int(element.max(initial=-1)) + 1 + step, step))
    for k in range(len(bounds) - 1):
        e, o = element[bounds[k]:bounds[k + 1]] - k * step, owner[bounds[k]:bounds[k + 1]]
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        is_left, is_right = row[o] >= 0, column[o] >= 0
        a[row[o[is_left]], e[is_left]] = 1
        b[column[o[is_right]], e[is_right]] = 1
        both += a @ b.T
    joint = both.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - joint
    a, b = np.nonzero((100 * joint >= percent * union) & (left[:, None] != right[None, :]))
    return left[a], right[b]


def links(rows: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the same classes as all pairs that are similar enough."""
    group = stage(connected(candidates(classes, percent)), "candidates")
    sizes = group.groupBy("component").agg(F.count("*").alias("size"))
    members = group.join(sizes, "component")

    def sets(table: pa.Table) -> pa.Table:
        elements, first = shingles(table, size)
        return pa.table({"node": table["doc_id"], "set": pa.array([pack(elements[a:b]) for a, b in zip(first[:-1], first[1:])], pa.binary())})

    texts = rows.select("doc_id", "text").join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    held = tiled(members.join(map_slabs(texts, sets, "node long, set binary", most=1 << 20), "node"), F.col("size"), TILE)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["component", "i", "j"]):
            found = []
            for at, to in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = table.slice(at, to - at)
                full = [unpack(b)[0] for b in own["set"].to_pylist()]
                i, j, side = own["i"][0].as_py(), own["j"][0].as_py(), own["side"].to_numpy()
                a, b = _verified(full, np.flatnonzero(side == i), np.flatnonzero(side == j), percent)
                found.append((a + at, b + at))
            yield _links(table, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        release()

    spread = held.select("component", "i", "j", "side", "node", "set").repartition("component", "i", "j")
    return spread.sortWithinPartitions("component", "i", "j").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the least id that
    links reach) and ``kept`` (whether that is its own)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = stage(sketches(rows, shingle, registers_for(percent)), "sketches")
    classes = stage(
        own.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "registers")).alias("least"))
        .select("f1", "f2", "n", F.col("least.doc_id").alias("node"), "least.registers"), "classes")
    same_id = own.where("n > 0").groupBy("doc_id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("doc_id")
    several = own.join(same_id, "doc_id").join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    found = links(rows, classes, shingle, percent).union(several.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    whole = stage(connected(found), "components")
    known = classes.select("f1", "f2", "node").join(whole, "node", "left").select(
        "f1", "f2", F.coalesce("component", "node").alias("component_id"))
    out = own.select("doc_id", "n", "f1", "f2").join(stage(known, "classes"), ["f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(frames.documents(spark, folder).select("doc_id", "text"))
