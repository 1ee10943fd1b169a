"""The prefix trie of conversations, with sums over all subtrees by parallel tree contraction.

A node is a distinct sequence of first turns. Turns are known by the MD5 of role and text; a node by its depth
and the sum, in four lanes of 32 bits, of hashes of its turns and their places (128 bits in all), so nodes follow
from running sums over each conversation, taken in two levels (``ordered``), and one grouping.

Sums over subtrees: in each round all leaves are raked, that is added to their parents, and of every chain of nodes
with one child those are spliced out that come before both neighbours in an order that halves chains
of consecutive depths. A tree of any shape, a single long conversation too, is gone after a number of
rounds that is logarithmic in its size. A raked node's sum is whole when it goes. A spliced node's
sum is its own plus that of the child it had then, which goes in a later round: so the rounds are expanded in
reverse, each out of the sums of those after it. Only the number of nodes left reaches the driver.

Joins of a round have unique keys on both sides. Children look up a parent's member by a join, but those of
the at most ``MOST_HOT`` parents with more than that share of all nodes by a broadcast. The members that end in a node are sorted by
range and digested in blocks, so a digest reads blocks and not rows.

Rows with a null ``conv_id`` belong to no conversation and are left out. A null role or text is empty, a null turn
comes first; rows of one turn are ordered by the MD5 of role and text, and repeated rows are repeated turns. An empty
table gives no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import struct
from ..staging import stage
from . import frames
from .ordered import scan

SHARED, GROUP = 6, 100
"""The query gives a conversation fewer than ``SHARED`` turns of the first one of its ``GROUP``."""

RUN = 1 << 16
"""Turns of a conversation that are joined in one place, at most."""

MOST_HOT = 10_000
BLOCK = 8192
"""Members of a node that are digested at once."""

_LANES = ("f1", "f2", "f3", "f4")
_NODE = "struct<depth:long,hi:long,lo:long>"


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns in order: ``conv_id``, ``place`` (from 0), ``print`` of role and text, ``size`` of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary")).alias("print"),
        F.length(text("text")).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("any"))  # equal rows must not be one sort key: they may fill many tasks
    found = scan(turns, "conv_id", ("conv_id", "turn", "print", "any"))
    return found.select("conv_id", (F.col("number") - 1).alias("place"), "print", "size")


def members(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of all conversations."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first one of their group: the turns (``conv_id, depth, print, size,
    last``) and the members (``conv_id, n_turns``)."""
    every = stage(members(turns).withColumns({
        "head": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("long"),
        "base": F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))}), "members")
    bases = every.where("conv_id = base").select("base", F.col("n_turns").alias("n_base"))
    made = every.join(bases, "base", "left").withColumn("given", F.least("head", F.coalesce("n_base", F.lit(0))))
    made = stage(made.withColumn("length", F.col("given") + F.greatest(F.col("n_turns") - F.col("head"), F.lit(0))), "members")
    # a conversation's turns are joined in runs, so a long one is spread over tasks
    runs = made.where("n_turns > head").select("conv_id", "head", "given", "length", F.explode(
        F.sequence(F.lit(0), F.expr(f"(n_turns - 1) div {RUN}"))).alias("run"))
    own = turns.withColumn("run", F.expr(f"place div {RUN}")).join(runs, ["conv_id", "run"]).where("place >= head").select(
        "conv_id", (F.col("place") - F.col("head") + F.col("given") + 1).alias("depth"), "print", "size", "length")
    heads = turns.where((F.col("place") < SHARED - 1) & (F.pmod("conv_id", F.lit(GROUP)) == 0)).select(
        F.col("conv_id").alias("base"), "place", "print", "size")
    given = made.where("given > 0").join(heads, "base").where("place < given").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "print", "size", "length")
    rows = own.unionByName(given).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return rows, made.select("conv_id", F.col("length").alias("n_turns"))


def _key(depth: Column, lanes: list[Column]) -> Column:
    mask = F.lit(0xFFFFFFFF).cast("long")
    a, b, c, d = (x.bitwiseAND(mask) for x in lanes)
    return F.struct(depth.alias("depth"), F.shiftleft(a, 32).bitwiseOR(b).alias("hi"), F.shiftleft(c, 32).bitwiseOR(d).alias("lo"))


def prefixes(turns: DataFrame) -> DataFrame:
    """For each turn the node it leads to and the one before it: ``conv_id, node, up, size, last``."""
    one, two = F.xxhash64("print", "depth"), F.xxhash64("depth", F.lit("second"), "print")
    mask = F.lit(0xFFFFFFFF).cast("long")
    hashed = turns.select("conv_id", "depth", "size", "last", *[
        x.alias(c) for c, x in zip(_LANES, (F.shiftrightunsigned(one, 32), one.bitwiseAND(mask),
                                            F.shiftrightunsigned(two, 32), two.bitwiseAND(mask)))],
        *[x.alias(f"own_{c}") for c, x in zip(_LANES, (F.shiftrightunsigned(one, 32), one.bitwiseAND(mask),
                                                       F.shiftrightunsigned(two, 32), two.bitwiseAND(mask)))])
    summed = scan(hashed, "conv_id", ("conv_id", "depth"), _LANES)
    return summed.select(
        "conv_id", _key(F.col("depth"), [F.col(c) for c in _LANES]).alias("node"),
        _key(F.col("depth") - 1, [F.col(c) - F.col(f"own_{c}") for c in _LANES]).alias("up"), "size", "last")


def root() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"))


def nodes(paths: DataFrame, every: DataFrame) -> DataFrame:
    """``node, up, conv_id`` (the least member), ``n_convs``, ``size`` (of the last text) of all nodes, the root too."""
    grown = paths.groupBy("node", "up").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    top = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root().alias("node"), F.lit(None).cast(_NODE).alias("up"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"))
    return grown.unionByName(top)


def subtree_sums(tree: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``node`` and, for each of ``values`` (longs), the sum over the node's subtree. ``tree`` has ``node``, ``up`` (null for
    roots only), ``leaf`` and the values; ``node`` is a struct that begins with ``depth``. A node carries the values of
    what was spliced out above it to the parent that it has then."""
    totals = lambda df: df.select("node", *values)
    both = (*values, *[f"over_{v}" for v in values])
    left = stage(tree.select("node", "up", "leaf", *values, *[F.lit(0).cast("long").alias(f"over_{v}") for v in values]), "tree")
    raked, spliced = [], []
    while left.where("up is not null").head(1):
        raked.append(totals(left.where("leaf and up is not null")))
        kids = left.where("up is not null").groupBy(F.col("up").alias("node")).agg(
            F.count_if(~F.col("leaf")).alias("inner"), F.max(F.when(~F.col("leaf"), F.col("node"))).alias("only"),
            *[F.coalesce(F.sum(F.when(F.col("leaf"), F.col(v) + F.col(f"over_{v}"))), F.lit(0)).alias(f"more_{v}") for v in values])
        inner = stage(left.where(~F.col("leaf")).join(kids, "node").select(
            "node", "up", "inner", "only", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values],
            *[f"over_{v}" for v in values]), "inner")
        # chains: nodes below a parent with one child that is no leaf; each is compared with its neighbours
        order = F.struct(F.expr("node.depth & -node.depth").alias("bit"), F.xxhash64("node").alias("draw"), F.col("node").alias("node"))
        chained = F.col("up").isNotNull() & (F.col("inner") == 1)
        chain = inner.where(chained).withColumn("order", order)
        above = chain.select(F.col("only").alias("node"), F.col("order").alias("above"))
        below = inner.select(F.col("node").alias("only"), F.when(chained, order).alias("below"),
                             *[F.col(f"over_{v}").alias(f"between_{v}") for v in values])
        gone = chain.join(above, "node", "left").join(below, "only").where(
            (F.col("above").isNull() | (F.col("order") < F.col("above"))) & (F.col("below").isNull() | (F.col("order") < F.col("below"))))
        gone = stage(gone.select("node", "up", "only", *both, *[f"between_{v}" for v in values]), "spliced")
        spliced.append(gone)
        lifted = gone.select(F.col("only").alias("node"), F.col("up").alias("new_up"),
                             *[(F.col(v) + F.col(f"over_{v}")).alias(f"more_{v}") for v in values])
        left = stage(inner.join(gone.select("node"), "node", "left_anti").join(lifted, "node", "left").select(
            "node", F.coalesce("new_up", "up").alias("up"), (F.col("inner") == 0).alias("leaf"), *values,
            *[(F.col(f"over_{v}") + F.coalesce(f"more_{v}", F.lit(0))).alias(f"over_{v}") for v in values]), "tree")
    found, later = totals(left), None
    for leaves, gone in zip(reversed(raked), reversed(spliced)):
        # the child of a spliced node went in a later round
        fresh = leaves
        if later is not None:
            known = later.select(F.col("node").alias("only"), *[F.col(v).alias(f"more_{v}") for v in values])
            fresh = leaves.unionByName(stage(gone.join(known, "only").select("node", *[
                (F.col(v) + F.col(f"between_{v}") + F.col(f"more_{v}")).alias(v) for v in values]), "sums"))
        later = fresh if later is None else later.unionByName(fresh)
        found = found.unionByName(fresh)
    return found


def _ends(paths: DataFrame, every: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the nodes in which members end."""
    ends = paths.where("last").select("node", "conv_id").unionByName(
        every.where("n_turns = 0").select(root().alias("node"), "conv_id"))
    rows = ends.select(F.col("node.depth").alias("depth"), F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "conv_id")
    order = ("depth", "hi", "lo", "conv_id")
    long, string = paths.schema["conv_id"].dataType, frames.T.StringType()
    blocks_of = struct(depth=long, hi=long, lo=long, part=frames.T.IntegerType(), k=frames.T.IntegerType(), ids=string, sha=string)
    schema = to_arrow_schema(blocks_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A node that is surely whole and one block is digested at once; else its members are a block."""
        part, key, held, k, first = TaskContext.get().partitionId(), None, [], 0, True
        for batch in batches:
            for depth, hi, lo, conv_id in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (depth, hi, lo):
                    if held:
                        whole = not first and k == 0
                        yield (*key, part, k, None, _sha(held)) if whole else (*key, part, k, ",".join(held), None)
                        first = False
                    key, held, k = (depth, hi, lo), [], 0
                elif len(held) >= BLOCK:
                    yield *key, part, k, ",".join(held), None
                    held, k = [], k + 1
                held.append(str(conv_id))
        if held:
            yield *key, part, k, ",".join(held), None

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key = sha = None
        for batch in batches:
            for depth, hi, lo, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "hi", "lo", "ids")]):
                if key == (depth, hi, lo):
                    sha.update(b",")
                else:
                    if key is not None:
                        yield *key, None, None, None, sha.hexdigest()
                    key, sha = (depth, hi, lo), hashlib.sha256()
                sha.update(ids.encode())
        if key is not None:
            yield *key, None, None, None, sha.hexdigest()

    def run(make):
        def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = []
            for row in make(batches):
                out.append(row)
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return batches_of

    cut = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run(blocks), blocks_of), "ends")
    loose = cut.where("ids is not null").repartition("depth", "hi", "lo").sortWithinPartitions("depth", "hi", "lo", "part", "k")
    done = cut.where("sha is not null").unionByName(loose.mapInArrow(run(digests), blocks_of))
    return done.select(F.struct("depth", "hi", "lo").alias("node"), F.col("sha").alias("ends_sha256"))


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _with_parents(found: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id``. ``found`` has ``n_children``; parents of more than one in ``MOST_HOT`` nodes are few."""
    many = F.lit(found.agg(F.greatest(F.lit(RUN), F.expr(f"count(*) div {MOST_HOT}"))).first()[0])
    parents = found.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > many).drop("n_children"))
    children = found.where("up is not null")
    easy = children.join(hot.select("up"), "up", "left_anti").join(parents.drop("n_children"), "up")
    return children.join(hot, "up").unionByName(easy).unionByName(
        found.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")), allowMissingColumns=True)


def prefix_trie(turns: DataFrame, every: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations. ``turns`` has ``conv_id, depth`` (from 1, dense), ``print, size, last``;
    ``every`` has ``conv_id, n_turns`` of all conversations, also those without turns."""
    paths = stage(prefixes(turns), "paths")
    grown = stage(nodes(paths, every), "nodes")
    children = grown.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    found = stage(grown.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    tree = found.select("node", "up", (F.col("n_children") == 0).alias("leaf"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    sums = subtree_sums(tree, ("n_leaves", "saved_tokens"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return _with_parents(found).join(sums, "node").join(_ends(paths, every), "node", "left").select(
        "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = numbered(frames.documents(spark, folder, "conversations"))
    return prefix_trie(*with_shared_heads(turns))
