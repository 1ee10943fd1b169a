"""Piece encoding against the library."""

import hashlib
import random

import pyarrow as pa
import pytest

from evenhand.llm import pieces
from evenhand.llm.queries import QUERIES

from .conftest import FOLDER, by_id, texts


@pytest.fixture(scope="module")
def encoder():
    return pieces.piece_encoder(pieces.default_model())


def check(encoder, all_texts):
    ids, bounds = encoder.encode(pa.chunked_array([pa.array(all_texts, pa.string())]))
    want = encoder.vocabulary.library.encode([t or "" for t in all_texts], num_threads=1)
    for i, own in enumerate(want):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == own, all_texts[i]


def test_texts_of_every_kind(encoder):
    check(encoder, [
        "hello world", "  hello   world ", "", None, "a\nb\tc", "　x", "Über naïve 日本 🙂 ´´", "\x00a", "▁a", "a▁ b",
        "<s> x</s>", "<unk>", "ﬁ ①", "é", "\r\n", "<0x41>", " ", " " * 5000, " " * 100 + "x", "x" * 30000, "ab" * 5000,
        *[" " * n for n in range(1, 80)], *["a" + " " * n + "the" + " " * n for n in range(1, 80)]])


@pytest.mark.parametrize("alphabet", ["aab", "-=_.*/ ", "0o. in", "abcdeést nin ", "的一是不了人我在有他这为之大来以个中", "xX▁ "])
def test_random_texts(encoder, alphabet):
    rng = random.Random(3)
    check(encoder, ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(2000)])


def test_random_pieces(encoder):
    rng = random.Random(4)
    library = encoder.vocabulary.library
    some = [library.id_to_piece(rng.randrange(259, len(library))) for _ in range(20000)]
    check(encoder, ["".join(rng.choices(some, k=rng.randint(1, 30))).replace("▁", " ") for _ in range(3000)])


def test_rounds_take_one_pair_where_a_merge_makes_a_better_one(encoder):
    """A small vocabulary in which a longer piece has a better rank than a part of it."""
    own = pieces.Vocabulary.__new__(pieces.Vocabulary)
    own.size, own.extra = 6, pieces.np.empty(0, pieces.np.int64)
    own.rank = pieces.np.array([9, 9, 9, 5, 2, 7], pieces.np.int32)  # a, b, c, ab, abc, bc
    own.pairs = pieces.HashTable()
    left, right, made = pieces.np.array([[0, 1, 3], [3, 2, 4], [1, 2, 5], [0, 5, 4], [4, 0, 3]]).T
    keep = made != 3
    own.pairs.put(own._keys(left[keep], right[keep]), made[keep])
    own.pairs.put(own._keys(pieces.np.array([0]), pieces.np.array([1])), pieces.np.array([3]))

    def one_by_one(symbols):
        rank = lambda i: own.ranks(own.merged(pieces.np.array([symbols[i]]), pieces.np.array([symbols[i + 1]])))[0]
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (rank(i), i))
            if rank(best) == pieces._NO_RANK:
                break
            symbols[best:best + 2] = own.merged(pieces.np.array([symbols[best]]), pieces.np.array([symbols[best + 1]])).tolist()
        return symbols

    rng = random.Random(5)
    for _ in range(300):
        word = [rng.randrange(3) for _ in range(rng.randint(1, 14))]
        got, _ = own._rounds(pieces.np.array(word, pieces.np.int32), pieces.np.array([len(word)]))
        assert got.tolist() == one_by_one(list(word)), word


def check_rows(encoder, all_texts, found):
    library = encoder.vocabulary.library
    for d, t in all_texts.items():
        ids = library.encode(t or "")
        assert (found[d]["n_tokens"], found[d]["ids_sha256"], found[d]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest()), d


def test_op12(spark, encoder, documents):
    check_rows(encoder, texts(documents), by_id(QUERIES["op12_pieces"](spark, FOLDER)))


@pytest.mark.parametrize("kind", ["awkward", "repeated", "empty"])
def test_awkward_tables(spark, encoder, request, kind):
    docs = request.getfixturevalue(kind)
    found = pieces.encode_pieces(docs, decoded=True)
    again = pieces.decode_pieces(found.select("doc_id", "ids", "rest"))
    library = encoder.vocabulary.library
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in docs.select("doc_id", "text").collect())
    for rows in (found.collect(), again.collect()):
        assert sorted((str(r.doc_id), r.ids) for r in rows) == want
        assert all(r.decoded == library.decode(r.ids) for r in rows)
    if kind == "awkward":
        assert sorted(map(str, found.select("rest.*").collect())) == sorted(map(str, docs.collect()))
