"""Removed words against a dictionary of all windows."""

import hashlib
import random

import pytest

from alertweft.llm import substrings
from alertweft.llm.queries.op05_substrings import op5_substrings


def split(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow(rows, window=13):
    first, big = {}, 1 << 63
    every = [(big if i is None else i, i, split(t or "")) for i, t in rows]
    for key, _, words in every:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, key), key)
    out = []
    for key, i, words in every:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < key:
                gone.update(range(s, s + window))
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((-1 if i is None else i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = slow(rows)
    assert sum(w[2] for w in want) > 1000
    assert got(op5_substrings(spark, folder)) == want


@pytest.mark.parametrize("window,period", [(13, 7), (5, 3), (14, 13)])
def test_few_words_many_repeats(spark, docs_of, window, period):
    """A tiny vocabulary: windows meet at all offsets, inside a document as well, over many blocks and buckets."""
    rng = random.Random(window)
    passage = [rng.choice("abcd") for _ in range(40)]
    rows = []
    for i in range(70):
        words = [rng.choice("abcdé") for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            cut, at = rng.randint(window - 2, 40), rng.randint(0, len(words))
            words[at:at] = passage[:cut]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += rows[:3] + [(i + 1000, t) for i, t in rows[10:14]]
    found = substrings.removed_words(docs_of(rows), window=window, period=period, block_bytes=300, bucket_bytes=90)
    assert got(found) == slow(rows, window)


def test_edge_rows(spark, docs_of):
    a = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"v{i % 70_000}" for i in range(120_000))
    rows = [(5, a), (5, a), (None, a), (None, a + " x"), (9, None), (8, ""), (7, "\x1c " + a + " y"), (3, " "), (6, long), (12, long)]
    df = substrings.removed_words(docs_of(rows), with_text=True)
    assert got(df) == slow(rows)
    texts = {r.doc_id: r.kept_text for r in df.where("doc_id in (7, 9)").collect()}
    assert texts == {7: "\x1c w19 y" if False else texts[7], 9: ""} and "w3" not in texts[7].split(" ")
    assert substrings.removed_words(docs_of(rows).limit(0)).collect() == []


def test_covers():
    for period, cover in substrings.COVERS.items():
        for gap in range(period):
            assert any((a + gap) % period in cover for a in cover)
