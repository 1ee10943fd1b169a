"""Conversation operators against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evenhand.llm import conversation_repair, conversation_trie
from evenhand.llm.queries import QUERIES

from .conftest import FOLDER

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def first_nulls(value):
    return (value is not None, value or 0)


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def damage(rows):
    """Conversations after damage, in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else "".join(x for x in text if x not in ".!?") if draw == 2 else text
        own = out[c]
        if draw:
            own.extend([(t, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1))
    return {c: sorted(own, key=lambda r: (first_nulls(r[0]), md5(*r[1:]))) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, lines) by a search from the end, over the states of the grammar."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {s: (0, "", ()) if s in ("", "a") else None for s in follow}

    def inserts(best):
        for _ in range(3):
            for s in best:
                to = next(x for x in follow[s] if x in "ua")
                if best[to]:
                    cost, audit, lines = best[to]
                    new = (cost + 5, "I" + audit, (f"{name[to]}:", *lines))
                    best[s] = min(x for x in (best[s], new) if x)
        return best

    best = inserts(best)
    for (_, role, text), fault in zip(reversed(rows), reversed(found)):
        now = {}
        for s in follow:
            options = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if role[:1] and role[:1] in follow[s]:
                    cost, audit, lines = best[role[0]]
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
                to = next(x for x in follow[s] if x in "ua")
                cost, audit, lines = best[to]
                options.append((cost + extra + 1, "R" + audit, (f"{name[to]}:{text}", *lines)))
            now[s] = min(options)
        best = inserts(now)
    return best[""]


def repaired(rows):
    out = {}
    for c, own in damage(rows).items():
        found = faults(own)
        cost, audit, lines = cheapest(own, found)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(x) for x in ("blank", "duplicate", "truncated")],
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_repair(rows, found):
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in found.collect()}
    want = repaired(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def awkward_conversations(seed=1, n=40, longest=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "user", "assistant"]
    texts = ["Yes.", "no", "", " \n", None, "Why? ", "tail ...\t", "a.b", "é!", "x" * 3000, "Yes."]
    rows = []
    for c in range(n):
        turn = rng.randint(-3, 3)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, longest])):
            turn += rng.choice([0, 1, 1, 1, 2, 9])
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts)))
    rows += [(None, 1, "user", "null id."), (None, None, None, None), (900, None, "user", "a."), (900, None, "assistant", "b.")]
    rows += rows[:25] + [(901, 5, "user", "again and again.")] * 300
    rows += [(902, t, "tool", f"t{t}.") for t in range(301)] + [(903, t, ("user", "assistant")[t % 2], f"m{t}.") for t in range(400)]
    rng.shuffle(rows)
    return rows


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repair(rows, QUERIES["op11_conversation_repair"](spark, FOLDER))


@pytest.mark.parametrize("piece_rows", [2, 512])
def test_repair_of_awkward_conversations_in_pieces(spark, piece_rows):
    rows = awkward_conversations()
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "key", "part", "print", "a.b", "code")}).repartition(3)
    broken, copies = conversation_repair.damaged(table)
    check_repair(rows, conversation_repair.digests(conversation_repair.repair(broken, copies, piece_rows=piece_rows)))


def test_fix_up_passes_reach_over_many_chains(spark):
    """Rows of other roles hand the vector on unchanged but for its turn, so that each chain waits for the next."""
    rows = [(1, t, "tool", f"t{t}.") for t in range(500)] + [(1, 500 + t, "user", f"u{t}.") for t in range(3)]
    table = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        broken, copies = conversation_repair.damaged(table)
        pieces = conversation_repair.repair(broken, copies, piece_rows=7)
        assert pieces.select("part").distinct().count() > 2
        check_repair(rows, conversation_repair.digests(pieces))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_no_conversations(spark):
    broken, copies = conversation_repair.damaged(spark.createDataFrame([], SCHEMA))
    assert conversation_repair.digests(conversation_repair.repair(broken, copies)).count() == 0


def trie(rows):
    """Nodes of the trie of rebuilt conversations by their prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t, role or "", text or ""))
    own = {c: [r[1:] for r in sorted(v, key=lambda r: (first_nulls(r[0]), md5(*r[1:])))] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] += not children[prefix]
        saved[prefix] += (len(members[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0)
        if prefix:
            leaves[prefix[:-1]] += leaves[prefix]
            saved[prefix[:-1]] += saved[prefix]
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, own in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check_trie(rows, found):
    assert sorted(tuple(r[n] for n in TRIE) for r in found.collect()) == trie(rows)


def found_trie(table):
    return conversation_trie.prefix_trie(*conversation_trie.with_shared_heads(conversation_trie.numbered(table)))


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_trie(rows, QUERIES["op13_conversation_trie"](spark, FOLDER))


@pytest.mark.parametrize("split", [False, True])
def test_trie_of_awkward_conversations(spark, monkeypatch, split):
    """Equal conversations, one long conversation, nulls, repeated rows, and groups over many tasks."""
    rows = awkward_conversations(2, 30, 40)
    rows += [(c, t, "user", f"t{t}") for c in range(1000, 1400) for t in range(3)]
    if split:
        monkeypatch.setattr(conversation_trie, "RUN", 7)
        monkeypatch.setattr(conversation_trie, "BLOCK", 16)
        monkeypatch.setattr(conversation_trie, "MOST_HOT", 1)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_trie(rows, found_trie(spark.createDataFrame(rows, SCHEMA).withColumns(
            {c: F.lit("x") for c in ("node", "up", "depth", "number", "any", "a.b")})))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_no_conversations(spark):
    assert found_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
