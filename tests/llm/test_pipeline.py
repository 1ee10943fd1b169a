"""Stages of the pipeline against plain versions, over whole tables."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from evenhand.llm import near_dedup

from .conftest import FOLDER, _frame, texts
from .test_operators import components, encoded, shingle_set


def near_pairs(pairs=12):
    """Pairs of texts of 200 words whose similarity is between 0.80 and 0.85, and their similarities."""
    rng = random.Random(11)
    rows, found = [], []
    for p in range(pairs):
        text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(text)
        for at in (40, 80, 120, 160):
            other[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * p, " ".join(text)), (2 * p + 1, " ".join(other))]
        a, b = (set(shingle_set(t)) for _, t in rows[-2:])
        found.append(len(a & b) / len(a | b))
    return rows, found


def test_near_copies_from_four_fifths_on_go(spark):
    rows, similarities = near_pairs()
    assert all(0.80 <= s < 0.85 for s in similarities)
    kept = {r.doc_id for r in pipeline.one_of_each_group(spark, _frame(spark, rows), FOLDER).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}
    assert {r.doc_id for r in near_dedup.near_duplicates(_frame(spark, rows)).where("kept").collect()} == {d for d, _ in rows}


def test_near_dedup_stage_keeps_the_least_of_each_component(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    plain = components(texts, percent=80)
    kept = {r.doc_id for r in pipeline.one_of_each_group(spark, documents, FOLDER).collect()}
    assert kept == {d for d in texts if plain[d][1] == d}


@pytest.mark.parametrize("percent, bands", [(85, 24), (80, 36), (100, 1)])
def test_bands_follow_from_the_threshold(percent, bands):
    assert near_dedup.registers_for(percent) == near_dedup.ROWS * bands
    assert percent == 100 or (1 - (percent / 100) ** near_dedup.ROWS) ** bands <= near_dedup.MISS


def test_repeated_rows_stay_once(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "other text of one"), (2, "four five"), (3, None), (3, None),
            (None, "no id here"), (None, "no id here"), (None, None), (None, None)]
    kept = [(r.doc_id, r.text) for r in pipeline.one_of_each_group(spark, _frame(spark, rows), FOLDER).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, set(rows)))


def test_least_score_follows_from_the_number_of_languages():
    assert pipeline.least_score(4) == pytest.approx(0.3)
    assert pipeline.least_score(100) == pytest.approx(0.012)
    assert pipeline.least_score(2) == pytest.approx(0.3)


def test_last_stage_yields_the_ids_of_its_pieces(spark, awkward):
    found = pipeline.packed_sequences(spark, awkward, FOLDER).collect()
    pieces = {}
    for r in sorted(found, key=lambda r: r.start):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).extend(r.ids)
    assert pieces == {d: [*ids, 1] for d, ids in encoded(texts(awkward)).items()}
