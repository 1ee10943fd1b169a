"""Every registered query of the subpackage against a brute-force version, on whole tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenhand.llm import decontaminate, language_id, license_scan, near_dedup, quality_rules, substring_dedup, token_counts, token_files
from evenhand.llm.queries import ORACLES, QUERIES
from evenhand.llm.tokens import default_vocabulary, encoder
from evenhand.staging import new_folder

from .conftest import ALNUM, FOLDER, by_id, texts, words


def sha(parts, glue=" "):
    return hashlib.sha256(glue.join(parts).encode()).hexdigest()


def in_order(all_texts):
    return sorted(all_texts.items(), key=lambda r: r[0])


def kept_words(all_texts, size=20):
    seen, out = set(), {}
    for d, t in in_order(all_texts):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            window = tuple(w[i:i + size])
            if window in seen:
                gone[i:i + size] = [True] * size
            seen.add(window)
        out[d] = (w, gone)
    return out


def check_substring(all_texts, got):
    for d, (w, gone) in kept_words(all_texts).items():
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), sum(gone)), d
        assert got[d]["kept_sha256"] == sha([x for x, g in zip(w, gone) if not g])


def test_op1(spark, documents):
    check_substring(texts(documents), by_id(QUERIES["op1_substring_dedup"](spark, FOLDER)))


def test_substring_on_awkward_rows(awkward):
    found = by_id(substring_dedup.substring_dedup(awkward, block_bytes=2000))
    for d, (w, gone) in kept_words(texts(awkward)).items():
        assert found[d]["kept"] == " ".join(x for x, g in zip(w, gone) if not g)
        assert found[d]["n_removed"] == sum(gone)


def test_op2_on_held_out_documents(spark, documents):
    got = by_id(QUERIES["op2_language_id"](spark, FOLDER))
    rows = documents.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {d for d, r in got.items() if r["held_out"]}
    assert np.mean([got[r.doc_id]["lang_pred"] == r.lang for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.train(["abc def", "xyz zyx"], ["a", "b"], steps=1, hidden=4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    text, length, truth = rng.integers(97, 110, (7, 5)).astype(np.uint8), np.array([7, 7, 3, 5, 1]), np.array([0, 1, 0, 1, 1])
    text[np.arange(7)[:, None] >= length] = 0
    _, grads = net.gradients(text, length, truth)
    for name, w in net.weights.items():
        at = tuple(int(rng.integers(0, s)) for s in w.shape)
        at = (at[0], int(text[2, 1])) if name.startswith("table") else at
        sides = []
        for e in (1e-3, -2e-3):
            w[at] += e
            sides.append(net.gradients(text, length, truth)[0])
        w[at] += 1e-3
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[name][at]) < 1e-5, name


def test_position_labels_cover_texts(awkward):
    net = language_id.train(["der und " * 9, "the and " * 9], ["de", "en"], steps=1)
    size = defaultdict(int)
    for r in language_id.position_labels(awkward, net).orderBy("doc_id", "start").collect():
        assert r.start == size[r.doc_id]
        size[r.doc_id] += r.length
    assert all(size[d] == len((t or "").encode()) for d, t in texts(awkward).items())


def encoded(all_texts):
    library = encoder(default_vocabulary()).library
    return {d: library.encode(t or "", add_special_tokens=False).ids for d, t in in_order(all_texts)}


def test_op3(spark, documents):
    got, ids, all_texts = by_id(QUERIES["op3_token_counts"](spark, FOLDER)), encoded(texts(documents)), texts(documents)
    for d, own in ids.items():
        assert tuple(got[d].values()) == (d, len((all_texts[d] or "").encode()), len(own), len(own) > 512)


@pytest.mark.parametrize("sample, size", [(1, 10), (2000, 5), (1 << 23, 1 << 15)])
def test_token_counts_do_not_depend_on_the_first_tier(spark, awkward, monkeypatch, sample, size):
    monkeypatch.setattr(token_counts, "SAMPLE_BYTES", sample)
    counts = token_counts.token_counts(awkward, frequent=size)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(counts) == exchanges(awkward)
    ids = encoded(texts(awkward))
    assert {d: r["n_tokens"] for d, r in by_id(counts).items()} == {d: len(own) for d, own in ids.items()}



@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_op4_against_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    want = con.execute(ORACLES["op4_license_scan"])
    names = [c[0] for c in want.description]
    got = QUERIES["op4_license_scan"](spark, folder).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_license_scan_on_awkward_rows(awkward):
    found = by_id(license_scan.scan(awkward))
    for d, t in texts(awkward).items():
        w = words(t, ALNUM, lower=True)
        at = [i for k in license_scan.BASE for i in range(len(w)) if w[i:i + len(k.phrase)] == k.phrase]
        r = found[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None)), d


def plain_labels(text, templates, share):
    """Labels of all starts of all templates, tried one by one."""
    w, out = words(text, ALNUM, True), set()
    for k, t in enumerate(templates):
        for i in range(-len(t.words), len(w)):
            at = lambda j: w[i + j] if 0 <= i + j < len(w) else None
            if all(at(t.at + j) == x for j, x in enumerate(t.phrase)):
                right = sum(at(j) == x for j, x in enumerate(t.words))
                if right / len(t.words) >= (0.0 if k < len(license_scan.BASE) else share):
                    out.add(t.label)
    return ",".join(sorted(out))


def test_licenses_differ_by_words_outside_the_phrase(spark):
    notice = next(t for t in license_scan.NOTICES if t.label == "unlicense")
    few = ["x"] * len(notice.words)
    few[notice.at:notice.at + len(notice.phrase)] = notice.phrase
    cut = " ".join(notice.words[notice.at:])
    rows = [(1, notice.notice.title()), (2, " ".join(few)), (3, notice.notice.replace("unencumbered", "x")), (4, cut), (5, "The  " + cut)]
    found = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: r["labels"] for d, r in found.items()} == {1: "unlicense", 2: "", 3: "", 4: "unlicense", 5: "unlicense"}


@pytest.mark.parametrize("share", [0.0, 0.6, 1.0])
def test_license_places_are_those_of_brute_force(spark, share):
    """Texts of damaged notices, and templates of one word, of repeated words and of a phrase at the end."""
    rng = random.Random(3)
    own = (license_scan.Template("one", "sole", "sole"), license_scan.Template("twice", "a b a b a c", "a c"),
           license_scan.Template("same", "z z z", "z z z"), *license_scan.NOTICES)
    every, rows = license_scan.BASE + own, []
    for d in range(300):
        parts = []
        for t in rng.choices(every, k=3):
            w = [x if rng.random() > 0.15 else rng.choice(["the", "license", "x"]) for x in t.words]
            parts += w[rng.randrange(3) if rng.random() < 0.3 else 0:] + ["y"] * rng.randrange(2)
        rows.append((d, rng.choice([" ", "  ", "-"]).join(parts).upper()))
    found = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices=own, share=share))
    for d, text in rows:
        assert found[d]["labels"] == plain_labels(text, every, share), text



def shingle_set(text, size=5):
    w = words(text, lower=True)
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(all_texts, percent=85):
    sets = {d: shingle_set(t) for d, t in in_order(all_texts)}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = [d for d in sets if sets[d]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def check_near(all_texts, got):
    for d, (n, component) in components(all_texts).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, component, d == component), d


def test_op5(spark, documents):
    check_near(texts(documents), by_id(QUERIES["op5_near_dedup"](spark, FOLDER)))


def test_near_dedup_on_awkward_rows(awkward):
    check_near(texts(awkward), by_id(near_dedup.near_duplicates(awkward)))


def test_chains_and_large_groups_of_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(250):
        own = list(base)
        for at in rng.integers(0, len(base), int(rng.integers(0, 5))):
            own[at] = f"v{rng.integers(0, 40)}"
        rows.append((int(rng.integers(0, 10**9)), " ".join(own)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(i, " ".join(chain[:150 + i])) for i in range(20)]
    monkeypatch.setattr(near_dedup, "TILE", 32)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(dict(rows), by_id(near_dedup.near_duplicates(docs)))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**51, 900).astype(np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    own = near_dedup.registers(np.concatenate([a, b, both]), np.cumsum([0, len(a), len(b), len(both)]))
    assert (own[2] == np.maximum(own[0], own[1])).all()
    near = np.union1d(a[:850], b[:50])
    x, y = near_dedup.registers(np.concatenate([a, near]), np.cumsum([0, len(a), len(near)]))
    guess = near_dedup.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(near))]))
    assert abs(guess[0] - 850 / 950) < 0.15


def base_counts(text):
    w = words(text)
    n, found = len(w), Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(n - 7) if found[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def longest_repeats(w):
    where, best = defaultdict(list), [0] * len(w)
    for i, x in enumerate(w):
        where[x].append(i)
    for places in where.values():
        for k, a in enumerate(places):
            for b in places[:k]:
                n = 0
                while a + n < len(w) and w[a + n] == w[b + n]:
                    n += 1
                best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


def check_rules(all_texts, got, most_words=2000):
    for d, t in all_texts.items():
        r, base = got[d], base_counts(t)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(r[k] for k in names) == base, d
        if base[0] <= most_words and max(Counter(words(t)).values(), default=0) <= 120:
            best = longest_repeats(words(t))
            covered = {j for i, n in enumerate(best) if n >= quality_rules.LEAST for j in range(i, i + n)}
            assert (r["longest_repeat"], r["n_covered"]) == (max(best, default=0), len(covered)), d
            assert r["kept"] == (not base[5] and 100 * len(covered) <= 30 * base[0] and max(best, default=0) <= quality_rules.MOST_REPEAT)


def test_op6(spark, documents):
    check_rules(texts(documents), by_id(QUERIES["op6_quality_rules"](spark, FOLDER)))


def test_rules_on_awkward_rows(awkward):
    check_rules(texts(awkward), by_id(quality_rules.quality_rules(awkward)))


def test_rules_keep_documents_of_good_quality(spark, documents):
    got = by_id(QUERIES["op6_quality_rules"](spark, FOLDER))
    good = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()
    assert all(got[r.doc_id]["kept"] or got[r.doc_id]["base_failed"] for r in good)


def test_op7(spark, documents):
    rows, ids = QUERIES["op7_packing"](spark, FOLDER).collect(), encoded(texts(documents))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, own in ids.items():
        own, at = np.array([*own, 1], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        assert at == 2048 or at & (at - 1) == 0


def test_op8_on_held_out_documents(spark):
    got = by_id(QUERIES["op8_quality_classifier"](spark, "/root/testdata/sf0.01"))
    marked = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in marked if got[r.doc_id]["held_out"]]
    assert len(held) > 50
    assert np.mean([got[r.doc_id]["predicted"] == r.quality for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())


def test_op9(spark, documents):
    got, start = by_id(QUERIES["op9_token_files"](spark, FOLDER)), 0
    for d, own in encoded(texts(documents)).items():
        own = np.array([*own, 2], "<u4")
        assert tuple(got[d].values()) == (d, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_token_files_have_many_segments_and_an_index(spark, awkward):
    """One file for each range at most, its segments found by its own index as by the list."""
    hot = awkward.select("doc_id", "text").unionAll(spark.range(400).select(
        F.lit(7).cast("long"), F.concat(F.lit("row of the same number "), F.col("id").cast("string"))))
    folder = new_folder(spark, "ids")
    listed = token_files.write_token_files(hot, folder, file_bytes=5000, segment_bytes=1000)
    rows = sorted(listed.collect(), key=lambda r: (r.part, r.segment))
    names = [p.name for p in Path(folder).iterdir() if p.name[0] not in "_."]
    assert sorted(names) == sorted({r.file for r in rows}) and len(rows) > len(names)
    held = []
    for name in sorted(names):
        with pa.OSFile(f"{folder}/{name}") as file:
            for own, row in zip(token_files.segments(file), [r for r in rows if r.file == name], strict=True):
                assert tuple(own.tolist()) == (row["at"], row["size"], row["n_docs"], row["n_ids"])
                held += token_files.Segment(file.read_at(own["size"], own["at"])).doc_ids.tolist()
    assert held == sorted(held) and held.count(7) == 401
    assert len(names) > 10
    got = sorted(token_files.read_token_files(folder, listed).collect(), key=lambda r: r.start)
    library = encoder(default_vocabulary()).library
    want = sorted((d, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in hot.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def hits(all_texts, items, size=13):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM, lower=True)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k:k + n])].add(str(i))
    sizes = {len(k) for k in windows}
    for d, t in all_texts.items():
        w = words(t, ALNUM, lower=True)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k:k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        yield d, len(w), len(hit), sorted(found)


def longest(all_texts, items, size=13):
    """Of each document the longest match that holds a window, tried from every pair of places."""
    out, plain = {}, [(str(i), words(t, ALNUM, lower=True)) for i, t in items]
    for d, t in all_texts.items():
        w, best = words(t, ALNUM, lower=True), []
        places = defaultdict(list)
        for k, x in enumerate(w):
            places[x].append(k)
        for i, own in plain:
            for a, x in enumerate(own):
                for b in places[x]:
                    n = 1
                    while a + n < len(own) and b + n < len(w) and own[a + n] == w[b + n]:
                        n += 1
                    if n >= min(size, len(own)):
                        best.append((-n, i, a, b))
        if best:
            n, *place = min(best)
            out[d] = (-n, *place)
    return out


def test_op10(spark, documents):
    got = by_id(QUERIES["op10_decontaminate"](spark, FOLDER))
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for d, n, hit, found in hits(texts(documents), items):
        assert tuple(got[d].values())[:6] == (d, n, hit, len(found), sha(found, ","), hit > 0 and 20 * hit >= n)
    matches = longest(texts(documents), items)
    assert {d: tuple(r.values())[6:] for d, r in got.items() if r["longest_words"]} == matches and len(matches) > 1


@pytest.mark.parametrize("item_bytes", [1 << 20, 600])
def test_contamination_in_parts_of_the_items(spark, awkward, monkeypatch, item_bytes):
    all_texts = texts(awkward)
    passage = words(all_texts[7], ALNUM, lower=True)
    items = [(1, " ".join(passage[5:40])), (2, "GENERAL public"), (3, None), (4, "..."), (5, " ".join(passage[30:])),
             (5, "it s"), (None, "naïve"), (6, "not there at all"), (7, " ".join(words(all_texts[17], ALNUM)[100:180]))]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(awkward, table))
    for d, n, hit, found in hits(all_texts, [("" if i is None else i, t) for i, t in items]):
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["item_ids"]) == (n, hit, found), d
    assert {d: tuple(r["longest"]) for d, r in got.items() if r["longest"]} == longest(all_texts, [("" if i is None else i, t) for i, t in items])
    first = decontaminate.longest_matches(awkward, table).where("item_id = '1'").collect()
    assert max(r.n_words for r in first) == 35


def test_no_other_module_imports_the_subpackage():
    import evenhand

    top = Path(evenhand.__file__).parent
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert not re.search(r"\bllm\b", path.read_text())
