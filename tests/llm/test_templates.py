"""Leaks against plain containment, and re-parameterised questions by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from alertweft.llm import templates
from alertweft.llm.queries.op09_templates import op9_templates

QUESTION = "On Monday Tom bought 12 apples for 3 dollars each and gave Anna 4 of them, then Tom sold the rest at 5 dollars. How much did Tom earn in total?"


def test_whole_table_has_every_contained_item(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): r for r in op9_templates(spark, folder).collect()}
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    assert whole and whole <= set(got)
    assert all(got[k].coverage == 1.0 and got[k].changed == 0 for k in whole)
    # nothing is a leak that does not share half of an item's runs of eight words
    words = lambda t: re.findall(r"\w+", t.lower())
    texts, asked = {d: " ".join(words(t)) for d, t in docs}, {i: words(t) for i, t in items}
    for d, i in set(got) - whole:
        runs = [" ".join(asked[i][k : k + 8]) for k in range(len(asked[i]) - 7)]
        assert sum(r in texts[d] for r in runs) >= len(runs) / 2


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, QUESTION), (2, "A train covers 120 km in 2 hours. What is its speed?"), (3, "Who wrote it down first?"), (4, "too short"),
         (5, None), (6, ""), (7, QUESTION.lower().replace("12", "99"))], "item_id long, text string")


def found(docs, bench):
    return {(r.doc_id, r.item_id): r for r in templates.leaks(docs, bench).collect()}


def test_reparameterised_questions(spark, docs_of, bench):
    changed = (QUESTION.replace("Tom", "Bert").replace("Anna", "Lucy").replace("Monday", "Friday").replace("12", "30").replace(" 3 ", " 6 ")
               .replace("4 of", "7 of").replace("5 dollars", "8 dollars"))
    mixed = changed.replace("did Bert", "did Carl")  # one name of the item stands for two
    pad = " ".join(f"filler{k} word{k}" for k in range(60))
    rows = {10: f"{pad} {QUESTION} {pad}", 11: f"{pad}\n{changed} {pad}", 12: f"{pad} {mixed}", 13: pad,
            14: "a train covers 90km in 3 minutes, what is its speed", 15: "we asked who wrote it down first? nobody", 16: "too short",
            17: QUESTION.upper()}
    got = found(docs_of(rows), bench)
    assert got[10, 1].changed == 0 and got[10, 1].coverage == 1.0
    assert got[11, 1].changed >= 6
    assert (12, 1) not in got and not any(d in (13, 16) for d, _ in got)
    assert (14, 2) in got and (15, 3) in got
    assert (17, 1) in got or (17, 7) in got


def test_edge_rows(spark, docs_of, bench):
    long = " ".join(f"w{i}" for i in range(150_000)) + " " + QUESTION
    docs = docs_of([(None, QUESTION), (None, "clean"), (1, None), (2, ""), (3, long), (3, "clean as well"), (4, QUESTION), (4, QUESTION)])
    got = found(docs, bench)
    assert {d for d, i in got if i == 1} == {None, 3, 4}
    kept = templates.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "clean"), (1, ""), (2, ""), (3, "clean as well")]
    assert found(docs.limit(0), bench) == {} and found(docs, bench.limit(0)) == {}
    assert templates.drop_leaks(docs, bench.limit(0)).count() == 8


def test_bitmap_loses_no_window(spark, bench):
    items = templates._scan(bench.select("item_id", F.col("item_id").alias("id"), F.col("text").cast("binary")), [])
    bits = templates._bitmap(items)
    for r in items.collect():
        place = (r.h % (1 << 64)) >> 40
        assert bits[place >> 3] >> (place & 7) & 1


def test_windows_agree_with_a_loop():
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join(rng.choice(["Bob", "bob", "12", "5km", "km", "red", "Red.", "***", "one", "x"]) for _ in range(30)).encode()
        codes, words, owner = templates.Stream().read(text)
        for token, slot, at in templates.streams(codes):
            assert len(token) == len(slot) == len(at) and (token[slot > 0] == slot[slot > 0]).all()
            assert not any(a == b > 0 for a, b in zip(slot, slot[1:]))
