"""Near copies of the pipeline stage: planted copies, brute force, and rows told apart by id and text."""

import random

import corpus_pipeline as P
import numpy as np
import pytest
from alertweft.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def edited(words, changes, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"new{rng.random()}"
    return out


def test_planted_copies_are_removed(spark, docs_of):
    """Every copy at a similarity of 0.8 to 0.97, and no text below 0.8."""
    rng, rows, copies, others = random.Random(3), {}, set(), set()
    for k in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 400]))]
        rows[2 * k] = " ".join(words)
        rows[2 * k + 1] = " ".join(edited(words, rng.randint(1, 1 + len(words) // 40), rng))
        (copies if alike(rows[2 * k], rows[2 * k + 1]) else others).add(2 * k + 1)
    assert len(copies) > 80 and len(others) > 5
    left = {r.doc_id for r in dict(P.STAGES)["simhash_near_dedup"](spark, docs_of(rows), "").collect()}
    assert left == set(rows) - copies


def test_large_group(spark, docs_of):
    """Copies that are near their common base but hardly near each other; the band is a star."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = {1000: " ".join(words)} | {k: " ".join(edited(words, 6, rng)) for k in range(120)}
    assert all(alike(rows[1000], rows[k]) for k in range(120))
    assert [r.doc_id for r in simhash.drop_near_copies(docs_of(rows)).collect()] == [0]


def test_rows_are_told_apart_by_id_and_text(spark, docs_of):
    long = " ".join(f"a{i}" for i in range(50))
    docs = docs_of([(1, long), (2, long + " end"), (2, "another clean text"), (None, "no id here"), (None, "no id here"), (None, "no  ID here"),
                    (5, None), (6, ""), (7, " \n")])
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.drop_near_copies(docs).collect())
    assert len(kept) == 4 and [k for k, _ in kept] == [0, 1, 2, 5] and kept[2] == (2, "another clean text")
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


def slow_kept(rows):
    """Smallest id of every class that pairs with four fifths of their shingles in common connect."""
    ids = sorted(rows)
    sets, union = [shingles(rows[i]) for i in ids], simhash.Union(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                union.join(i, j)
    return {ids[union.find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("texts,low,high,part", [(200, 2, 4, 1024), (600, 2, 4, 1024), (600, 3, 5, 100)])
def test_families_without_a_center(spark, docs_of, monkeypatch, texts, low, high, part):
    """Copies of one text with a few words changed, many of which are near few others only."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(texts + high)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = {k: " ".join(edited(words, rng.randint(low, high), rng)) for k in range(texts)}
    want = slow_kept(rows)
    assert 1 < len(want) < texts
    assert {r.doc_id for r in simhash.drop_near_copies(docs_of(rows)).collect()} == want


def test_set_links_against_pairs():
    rng = np.random.default_rng(1)
    for n, split in ((1, 1), (40, 40), (40, 15), (90, 90)):
        base = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(80) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(n)]
        sets[0] = sets[0][:0]
        known = np.arange(n)
        known[3:6] = 3
        pairs = [(i, j) for i in range(n) for j in range(i) if split == n or (j < split <= i)]
        true = [(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        slow, fast = simhash.Union(n), simhash.Union(n)
        for u, found in ((slow, true), (fast, simhash.set_links(sets, known, split, 0.8))):
            for i, j in [*found, *((3, k) for k in range(4, 6) if k < n)]:
                u.join(i, j)
        assert [slow.find(i) for i in range(n)] == [fast.find(i) for i in range(n)]


def test_whole_rows_stay_as_they_are(spark):
    """Columns named like inner ones, rows that differ in another column only, and empty tables."""
    names = ["_row", "row", "id", "digest", "key", "class", "cluster", "fp", "n", "left", "first", "bands"]
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(2, text, "b", *names), (2, text, "a", *names), (3, text + " x", "c", *names), (None, "other", "d", *names)],
                                 f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[2:] for r in kept.collect()) == [("a", *names), ("d", *names)]


def test_parts_of_a_large_band_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 10)
    _, signature = simhash.sketch(simhash.digests(b"one two three four five six seven", 5))
    rows = [(k, [7], bytearray(signature.tobytes())) for k in range(45)]
    found = simhash.band_links(spark.createDataFrame(rows, "key long, bands array<long>, signature binary")).distinct().collect()
    union = simhash.Union(45)
    for r in found:
        union.join(r.a, r.b)
    assert {union.find(k) for k in range(45)} == {0} and np.unique([r.a for r in found]).size > 1
