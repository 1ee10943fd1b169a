"""Word helpers, suffix arrays, pre-tokens and encodings against plain versions."""

import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evenhand.llm import token_files
from evenhand.llm.components import labels
from evenhand.llm.packing import fill
from evenhand.llm.suffix_array import SuffixArray, dense_ids
from evenhand.llm.tokens import HashTable, default_vocabulary, encoder
from evenhand.llm.words import (
    ALNUM, SPACED, Words, deltas, pack, slabs, text_bytes, undeltas, unpack, window_hashes)

from .conftest import ALNUM as ALNUM_PATTERN
from .conftest import words

texts_ = st.lists(st.one_of(st.none(), st.text(alphabet="ab AZ\n\t09.'é日\x00\x85 🙂", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts_)
def test_words_are_those_of_the_patterns(texts):
    for allowed, pattern, lower in ((SPACED, None, False), (ALNUM, ALNUM_PATTERN, True)):
        w = Words(*text_bytes(pa.array(texts, pa.string())), allowed)
        expected = [words(t, pattern, lower) if pattern else words(t) for t in texts]
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
        low = [x.translate({c: c + 32 for c in range(65, 91)}) for x in got] if lower else got
        assert low == list(itertools.chain.from_iterable(expected))
        assert w.counts.tolist() == [len(x) for x in expected]
        hashes, known = w.hashes(lower), {}
        for word, h in zip(low, hashes.tolist()):
            assert known.setdefault(word, h) == h
        assert len(set(known.values())) == len(known)


def test_hashes_do_not_depend_on_the_place():
    long_ = "word " * 300000 + "x" * 1500000 + " word end"
    w = Words(*text_bytes(pa.array([long_, "word end", "x" * 1500000])), SPACED)
    h = w.hashes()
    assert len(set(h[:300000].tolist())) == 1
    assert h[300001] == h[0] == h[300003]
    assert h[300002] == h[300004]
    assert h[300000] == h[300005]
    at = w.windows(2)
    two = window_hashes(h, at, 2)
    assert two[at == 300001] == two[at == 300003]


def test_slabs_keep_rows_and_bounds():
    table = pa.table({"text": pa.array(["a" * n for n in (5, 0, 900, 3, 2000, 1, 1, 700)] + [None]), "k": list(range(9))})
    parts = list(slabs(table.to_batches(max_chunksize=4), most=1000))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(9))
    for p in parts:
        size = sum(len(t or "") for t in p["text"].to_pylist())
        assert size <= 1000 or p.num_rows == 1


@given(st.lists(st.integers(0, 2**60), max_size=50))
def test_packed_arrays(values):
    up = np.array(sorted(values), np.int64)
    assert undeltas(unpack(pack(deltas(up)))[0]).tolist() == up.tolist()
    ids, back = dense_ids(np.array(values, np.uint64))
    assert ids[back].tolist() == values if values else not len(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=5), st.lists(st.integers(1, 5), min_size=1, max_size=20))
def test_suffix_array(docs, item):
    flat = np.array([x * 2**40 for d in docs for x in d], np.uint64)
    array = SuffixArray(flat, np.array([len(d) for d in docs]), 32)
    suffixes = [(d, i) for d in range(len(docs)) for i in range(len(docs[d]))]
    place = {int(array.starts[d]) + i: (d, i) for d, i in suffixes}
    order = [place[int(p)] for p in array.order]
    assert sorted(order) == suffixes
    full = [docs[d][i:] for d, i in order]
    assert all(a[:32] <= b[:32] for a, b in itertools.pairwise(full))
    query = np.array([x * 2**40 for x in item], np.uint64)
    n = len(item)
    low, high, longest, where = array.search(query, np.full(n, n), np.minimum(3, n - np.arange(n)))
    for j in range(n):
        m = min(3, n - j)
        assert high[j] - low[j] == sum(f[:m] == item[j:j + m] for f in full)
        common = [next((k for k in range(min(len(f), n - j)) if f[k] != item[j + k]), min(len(f), n - j)) for f in full]
        assert longest[j] == max(common, default=0)
        if longest[j]:
            d, i = place[int(where[j])]
            assert docs[d][i:i + longest[j]] == item[j:j + longest[j]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_common_prefixes(doc):
    array = SuffixArray(np.array(doc, np.uint64), np.array([len(doc)]), max(len(doc), 1), prefixes=True)
    common = array.common().tolist()
    for k in range(1, len(doc)):
        a, b = doc[array.order[k - 1]:], doc[array.order[k]:]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert common[k] == n


def test_hash_table():
    rng, table = np.random.default_rng(1), HashTable(4)
    keys = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64))
    for at in range(0, len(keys), 700):
        table.put(keys[at:at + 700], np.arange(at, min(at + 700, len(keys))))
    assert table.get(keys).tolist() == list(range(len(keys)))
    assert set(table.get(keys + np.uint64(1)).tolist()) <= {-1} | set(range(len(keys)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n'strevlmdx1.é \x85"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_ids_are_those_of_the_library(texts):
    own = encoder(default_vocabulary())
    ids, bounds = own.encode(pa.chunked_array([pa.array(texts, pa.string())]))
    expected = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60000), max_size=1500), st.sampled_from([0, 50, 90, 98, 100]))
def test_token_file_round_trip(ids, percentile):
    raw = token_files.write_ids(np.array([3]), np.array([len(ids)]), np.array(ids, np.uint32), percentile)
    own = token_files.Segment(raw)
    assert own.read().tolist() == ids
    assert own.doc_ids.tolist() == [3]
    assert own.lengths.tolist() == [len(ids)]
    if own.blocks > 2:
        assert own.read(1, 3).tolist() == ids[256:768]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fill_leaves_the_least_slack(counts, room):
    chosen = fill(dict(counts), room)
    assert all(n <= counts[k] for k, n in chosen.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * t for s in sums for t in range(n + 1)}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


@given(st.integers(1, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=15))
def test_labels(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    got = labels(n, np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))
    want = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got.tolist() == want
