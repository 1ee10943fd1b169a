"""Repair of the structure of conversations, by a parallel Viterbi search with rank convergence.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Rows are kept (cost 0),
given the role user or assistant (1) or deleted (2), empty rows are inserted (5), and a truncated row
that stays costs 5. Blank and repeated rows must go. Of the cheapest repairs the one with the
least string of edits (D, I, K, R) is taken.

The cheapest cost from a place to the end is a vector over four states (start, after system, after user,
after assistant), and each row maps the vector after it to the one before it. A conversation
is cut into pieces that are searched at the same time: each piece starts from a speculative vector, that
of the end of a conversation. Fix-up passes then run those chains of pieces again whose next chain turned
out to begin with another vector, until all vectors differ from those used by constants only; a chain stops as soon
as a piece gives the vector it gave before. The constants, stitched together, are the cost, and the vectors
of all places drive the trace: from the state where a piece starts, the least edit that is on a
cheapest path. Where pieces start follows from the states each chain leads to from all four.

Rows are ordered by range over the whole table, so a conversation with a third of all rows is spread over
many tasks. Equal rows of one turn are counted first and are one row of a piece. Rows that a task can see whole
conversations of are done in one pass. The SHA-256 of a conversation has to read all its text in order; it is
taken from pieces, as a stream of one task that holds one piece.

Nulls: a null role or text is one blank, a null ``conv_id`` is a conversation of its own, a null turn comes first.
Rows of one turn are ordered by the MD5 of role and text. Repeated rows are repeated turns, of which the
first stays. An empty text is blank. A role that is empty or begins with another letter
than s, u or a can be changed or deleted only. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import struct
from ..staging import stage
from . import frames

BLANKS = " \t\n\x0b\f\r"
PIECE_ROWS, PIECE_BYTES = 512, 1 << 18
"""A piece has no more rows or bytes of text than this, but for one longer row."""

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
"""The state after a row that is inserted or given a role."""
ROLE = {USER: "user", ASSISTANT: "assistant"}
CLOSING = (0, 10, 5, 0)
"""The cost of inserts at the end, by state."""
DELETE, INSERT, RENAME, CUT_OFF = 2, 5, 1, 5
OTHER, TRUNCATED, FORCED = 3, 4, 8
"""Codes of rows: 0 to 3 for the roles system, user, assistant and others, more by 4 if truncated; 8 must go."""

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_VECTOR = T.ArrayType(_I)
PIECES = struct(
    conv_id=_L, key=_S, part=_I, k=_I, whole=T.BooleanType(), codes=T.BinaryType(), copies=T.ArrayType(_L),
    turns=T.ArrayType(struct(role=_S, text=_S)), audit=_S, cost=_L, n_rows=_L, blank=_L, duplicate=_L, truncated=_L,
    illegal=_L, first_turn=_L, last_turn=_L, n_turns=_L, first_initial=_S, last_initial=_S)
CHAINS = struct(key=_S, part=_I, k=_I, codes=T.BinaryType(), copies=T.ArrayType(_L), after=_VECTOR, before=_VECTOR, offset=_L)
STARTS = struct(key=_S, part=_I, k=_I, start=_I, after=_VECTOR, before=_VECTOR, offset=_L)
DIGESTS = struct(conv_id=_L, gaps=_L, blank=_L, duplicate=_L, truncated=_L, illegal=_L, cost=_L, audit=_S, repaired_sha256=_S)

Vector = tuple[int, ...]


def _kept_to(code: int, state: int) -> int | None:
    """The state after a row that is kept, if it may stand there."""
    initial = code % 4
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def _edits(code: int, state: int, after: Vector) -> list[tuple[str, int, int]]:
    """Edits of a row as (letter, cost to the end, state after it), in the order of their letters."""
    edits = [("D", DELETE + after[state], state)]
    if code != FORCED:
        extra = CUT_OFF if code & TRUNCATED else 0
        kept = _kept_to(code, state)
        if kept is not None:
            edits.append(("K", extra + after[kept], kept))
        edits.append(("R", RENAME + extra + after[NEXT[state]], NEXT[state]))
    return edits


@lru_cache(1 << 16)
def _before(code: int, after: Vector) -> tuple[Vector, int]:
    """The vector before a row, less its least entry, and that entry."""
    costs = [min(e[1] for e in _edits(code, s, after)) for s in range(4)]
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(1 << 16)
def _choice(code: int, after: Vector, state: int) -> tuple[str, int]:
    """The least edits up to and with a row, and the state after it."""
    before, offset = _before(code, after)
    letters = ""
    while True:
        edits = [*_edits(code, state, after), ("I", INSERT + before[NEXT[state]] + offset, NEXT[state])]
        letter, _, state = min(e for e in edits if e[1] == before[state] + offset)
        letters += letter
        if letter != "I":
            return letters, state


def search(codes: Iterable[int], copies: Iterable[int], after: Vector) -> tuple[list[Vector], Vector, int]:
    """The vectors after each row of a piece, the one before the piece, and the constant between
    that and the one after the piece."""
    vectors, total = [], 0
    for code, n in zip(reversed(list(codes)), reversed(list(copies))):
        vectors.append(after)
        if code == FORCED:
            total += DELETE * n
        else:
            after, offset = _before(code, after)
            total += offset + DELETE * (n - 1)
    return vectors[::-1], after, total


def leads_to(codes: Iterable[int], vectors: list[Vector], state: int) -> int:
    """The state after a piece that starts in ``state``."""
    for code, after in zip(codes, vectors):
        if code != FORCED:
            state = _choice(code, after, state)[1]
    return state


def trace(codes: Iterable[int], copies: Iterable[int], rows: Iterable[tuple], vectors: list[Vector], state: int,
          last: bool) -> tuple[str, list[dict]]:
    """The edits of a piece and the rows that it has after them; ``last`` closes the conversation."""
    audit, turns = [], []
    for code, n, after, (role, text) in zip(codes, copies, vectors, rows):
        if code == FORCED:
            audit.append("D" * n)
            continue
        letters, end = _choice(code, after, state)
        for letter in letters:
            if letter == "I":
                state = NEXT[state]
                turns.append({"role": ROLE[state], "text": ""})
            elif letter == "K":
                turns.append({"role": role, "text": text})
            elif letter == "R":
                turns.append({"role": ROLE[NEXT[state]], "text": text})
        state = end
        audit.append(letters + "D" * (n - 1))
    while last and CLOSING[state]:
        state = NEXT[state]
        audit.append("I")
        turns.append({"role": ROLE[state], "text": ""})
    return "".join(audit), turns


def _rows(conversations: DataFrame, copies: Column) -> DataFrame:
    """One row for equal rows of a turn: their number, and a code. A row of no copies stays for each
    conversation that has such."""
    filled = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.cast("long").alias("n"))
    there = F.col("n") > 0
    marked = filled.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"),
        F.when(there, F.col("text")).alias("text"), "n",
        F.when(there, F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("print")
    ).withColumns({"key": F.coalesce(F.col("conv_id").cast("string"), F.lit("null")),
                   "at": F.coalesce(F.col("turn").cast("string"), F.lit("null"))})
    marked = marked.withColumn("print", F.coalesce("print", F.lit("")))
    counted = marked.groupBy("key", "at", "print").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("conv_id", "turn", "role", "text")])
    # where role and text are seen first: a null turn comes before all others
    firsts = marked.where(F.col("print") != "").groupBy("key", "print").agg(
        F.when(F.max(F.col("turn").isNull()), F.lit("null")).otherwise(F.min("turn").cast("string")).alias("at"),
        F.lit(True).alias("first"))
    found = counted.join(firsts, ["key", "at", "print"], "left")
    end = F.expr("rtrim(' \\t\\n\\u000b\\f\\r', text)")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    code = code + F.when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return found.select("conv_id", "key", "turn", "role", "text", "n", "print",
                        F.when(end == "", F.lit("blank")).when(F.col("first").isNull(), F.lit("duplicate")).alias("fault"),
                        code.alias("code"))


class _Piece:
    """Rows of one conversation, in order."""

    def __init__(self, conv_id: int | None, key: str, part: int, k: int) -> None:
        self.values = {"conv_id": conv_id, "key": key, "part": part, "k": k, "audit": None, "cost": None, "n_rows": 0,
                       "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_turn": None, "last_turn": None,
                       "n_turns": 0, "first_initial": None, "last_initial": None}
        self.codes, self.copies, self.rows, self.size = [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, n: int, fault: str | None, code: int) -> None:
        v, initial = self.values, role[:1]
        if v["last_initial"] is None:
            v["first_initial"] = initial
        elif v["last_initial"] + initial not in ("su", "ua", "au"):
            v["illegal"] += 1
        v["illegal"] += n - 1
        v["last_initial"] = initial
        v["n_rows"] += n
        if turn is not None and turn != v["last_turn"]:
            v["first_turn"] = turn if v["first_turn"] is None else v["first_turn"]
            v["last_turn"], v["n_turns"] = turn, v["n_turns"] + 1
        if fault == "blank":
            v["blank"] += n
        else:
            v["duplicate"] += n if fault else n - 1
            v["truncated"] += bool(not fault and code & TRUNCATED)
        self.codes.append(FORCED if fault else code)
        self.copies.append(n)
        self.rows.append((role, "" if fault else text))
        self.size += len(role) + (0 if fault else len(text))

    def done(self) -> dict:
        vectors, before, total = search(self.codes, self.copies, CLOSING)
        audit, turns = trace(self.codes, self.copies, self.rows, vectors, START, True)
        return self.values | {"whole": True, "audit": audit, "turns": turns, "cost": total + before[START]}

    def loose(self) -> dict:
        return self.values | {"whole": False, "codes": bytes(self.codes), "copies": self.copies,
                              "turns": [{"role": r, "text": t} for r, t in self.rows]}


def _cut(piece_rows: int, piece_bytes: int):
    """Pieces of the conversations of a sorted partition. Those that surely begin and end in it, and are one
    piece, are repaired at once."""
    schema = to_arrow_schema(PIECES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, piece, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            for conv_id, key, turn, role, text, n, fault, code in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is None or piece.values["key"] != key:
                    if piece is not None:
                        yield piece.loose() if first or piece.values["k"] else piece.done()
                        first = False
                    piece = _Piece(conv_id, key, part, 0)
                if not n:
                    continue
                if len(piece.codes) >= piece_rows or piece.codes and piece.size + len(text) > piece_bytes:
                    yield piece.loose()
                    piece = _Piece(conv_id, key, part, piece.values["k"] + 1)
                piece.add(turn, role, text, n, fault, code)
        if piece is not None:
            yield piece.loose()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(pieces(batches), schema)

    return run


def _in_batches(rows: Iterable[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _chain(table: pa.Table) -> pa.Table:
    """Searches a chain of pieces, from its end; ``next`` is the vector after it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    after = tuple(rows[-1]["next"])
    for row in reversed(rows):
        if row["before"] is not None and tuple(row["after"]) == after:
            break  # this piece and all before it were searched with this vector, but for a constant
        _, before, offset = search(row["codes"], row["copies"], after)
        row |= {"after": list(after), "before": list(before), "offset": offset}
        after = before
    return pa.Table.from_pylist([{f: r[f] for f in CHAINS.fieldNames()} for r in rows], to_arrow_schema(CHAINS))


def _vectors(loose: DataFrame) -> DataFrame:
    """The pieces (of ``CHAINS``) with the vectors after and before them, which are right but for constants.
    A pass searches chains, the pieces that one task had of a conversation; there are as many passes at most as
    a conversation has chains, and each searches those only whose next chain begins with another vector."""
    closing = F.array(*[F.lit(c) for c in CLOSING])
    blank = loose.select("key", "part", "k", "codes", "copies", *[
        F.lit(None).cast(CHAINS[c].dataType).alias(c) for c in ("after", "before", "offset")])
    known = stage(blank.withColumn("next", closing).groupBy("key", "part").applyInArrow(_chain, CHAINS), "vectors")
    while True:
        ends = known.groupBy("key", "part").agg(
            F.min_by("before", "k").alias("begins"), F.max_by("after", "k").alias("used"))
        chains = Window.partitionBy("key").orderBy("part")
        changed = ends.withColumn("next", F.coalesce(F.lead("begins").over(chains), closing)).where(
            F.col("next") != F.col("used")).select("key", "part", "next")
        changed = stage(changed, "changed")
        if not changed.head(1):
            return known
        again = known.join(changed, ["key", "part"]).groupBy("key", "part").applyInArrow(_chain, CHAINS)
        known = stage(known.join(changed, ["key", "part"], "left_anti").select(*CHAINS.fieldNames()).unionByName(again), "vectors")


def _states(known: DataFrame) -> DataFrame:
    """The state in which each piece starts."""

    def ends(table: pa.Table) -> pa.Table:
        states = list(range(4))
        for row in sorted(table.to_pylist(), key=lambda r: r["k"]):
            vectors, _, _ = search(row["codes"], row["copies"], tuple(row["after"]))
            to = {s: leads_to(row["codes"], vectors, s) for s in set(states)}
            states = [to[s] for s in states]
        return pa.table({"key": table["key"][:1], "part": table["part"][:1], "ends": pa.array([states], pa.list_(pa.int32()))})

    def starts_of_chains(table: pa.Table) -> pa.Table:
        state, out = START, []
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            out.append({"key": row["key"], "part": row["part"], "start": state})
            state = row["ends"][state]
        return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int32()), ("start", pa.int32())]))

    def starts_of_pieces(table: pa.Table) -> pa.Table:
        rows, out = sorted(table.to_pylist(), key=lambda r: r["k"]), []
        state = rows[0]["start"]
        for row in rows:
            out.append({"key": row["key"], "part": row["part"], "k": row["k"], "start": state,
                        "after": row["after"], "before": row["before"], "offset": row["offset"]})
            vectors, _, _ = search(row["codes"], row["copies"], tuple(row["after"]))
            state = leads_to(row["codes"], vectors, state)
        return pa.Table.from_pylist(out, to_arrow_schema(STARTS))

    chains = known.groupBy("key", "part").applyInArrow(ends, "key string, part int, ends array<int>")
    begins = chains.groupBy("key").applyInArrow(starts_of_chains, "key string, part int, start int")
    return known.join(begins, ["key", "part"]).groupBy("key", "part").applyInArrow(starts_of_pieces, STARTS)


def _traced(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """Loose pieces with their edits and repaired rows. The cost of a conversation is in its first piece's
    entry and in the constants of all pieces."""
    last = F.lead("part").over(Window.partitionBy("key").orderBy("part", "k")).isNull()
    placed = _states(known).withColumn("last", last)
    schema = to_arrow_schema(PIECES)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    vectors, _, _ = search(row["codes"], row["copies"], tuple(row["after"]))
                    given = [(t["role"], t["text"]) for t in row["turns"]]
                    audit, turns = trace(row["codes"], row["copies"], given, vectors, row["start"], row["last"])
                    first = row["first"] and row["before"][START]
                    yield row | {"audit": audit, "turns": turns, "cost": row["offset"] + (first or 0), "codes": None, "copies": None}

        return _in_batches(({f: r[f] for f in PIECES.fieldNames()} for r in rows()), schema)

    first = F.lag("part").over(Window.partitionBy("key").orderBy("part", "k")).isNull()
    return pieces.join(placed.withColumn("first", first), ["key", "part", "k"]).mapInArrow(repaired, PIECES)


def repair(conversations: DataFrame, copies: Column | None = None, *, piece_rows: int = PIECE_ROWS,
           piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Repaired conversations (columns ``conv_id, turn, role, text``) in pieces: of each piece the rows as
    repaired (``turns``), the edits (``audit``), its part of the cost, and counts of faults. Pieces of a conversation
    are ordered by ``part`` and ``k``; most have one. ``copies`` says how often a row stands there; a row of no
    copies only says that its conversation exists."""
    rows = _rows(conversations, F.lit(1) if copies is None else copies)
    order = ("conv_id", "turn", "print")
    frames.small_batches(conversations.sparkSession)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "key", "turn", "role", "text", "n", "fault", "code")
    pieces = stage(ordered.mapInArrow(_cut(piece_rows, piece_bytes), PIECES), "pieces")
    loose = pieces.where(~F.col("whole"))
    known = _vectors(loose)
    return pieces.where("whole").unionByName(stage(_traced(loose, known), "repaired"))


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, out of its pieces."""
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    whole = pieces.where("whole").withColumns({
        "gaps": gaps, "repaired_sha256": F.sha2(F.array_join(F.transform("turns", line), "\n").cast("binary"), 256)}).select(*names)
    columns = to_arrow_schema(DIGESTS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held["key"] != row["key"]:
                    if held is not None:
                        yield _digest(held)
                    held = row | {"sha": hashlib.sha256(), "any": False, "audits": []}
                else:
                    _join(held, row)
                held["audits"].append(row["audit"])
                for t in row["turns"]:
                    held["sha"].update(f"{'\n' if held['any'] else ''}{t['role']}:{t['text']}".encode())
                    held["any"] = True
        if held is not None:
            yield _digest(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(joined(batches), columns)

    rest = pieces.where(~F.col("whole")).repartition("key").sortWithinPartitions("key", "part", "k")
    return whole.unionByName(rest.mapInArrow(run, DIGESTS))


def _join(held: dict, row: dict) -> None:
    """Adds the counts of the next piece of a conversation."""
    if row["first_initial"] is not None:
        if held["last_initial"] is not None:
            held["illegal"] += held["last_initial"] + row["first_initial"] not in ("su", "ua", "au")
        held["last_initial"] = row["last_initial"]
    if row["first_turn"] is not None:
        held["n_turns"] -= row["first_turn"] == held["last_turn"]
        held["first_turn"] = row["first_turn"] if held["first_turn"] is None else held["first_turn"]
        held["last_turn"] = row["last_turn"]
    for name in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"):
        held[name] += row[name]


def _digest(held: dict) -> dict:
    gaps = 0 if held["first_turn"] is None else held["last_turn"] - held["first_turn"] + 1 - held["n_turns"]
    return {"conv_id": held["conv_id"], "gaps": gaps, "audit": "".join(held["audits"]),
            "repaired_sha256": held["sha"].hexdigest(),
            **{n: held[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")}}


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the damage that the query does to them, and how often each then stands there."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    drawn = conversations.select("conv_id", "turn", *[v.alias(c) for c, v in filled.items()],
                                 (F.crc32(name.cast("binary")) % 20).alias("drawn"))
    draw = F.col("drawn")
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = drawn.select("conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                        text.alias("text"), "drawn")
    return rows, F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows, copies = damaged(frames.documents(spark, folder, "conversations"))
    return digests(repair(rows, copies))
