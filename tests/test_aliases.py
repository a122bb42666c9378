"""Alias replacement against one alternation, longest key first, of plain Python."""

import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from alertweft.operators import aliases as A


def slow(text, mapping):
    if text is None or not mapping:
        return text
    keys = sorted(mapping, key=len, reverse=True)
    return re.compile("|".join(re.escape(k) for k in keys), re.I).sub(lambda m: mapping[m.group(0).lower()], text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abAB.\\E ", max_size=40), st.dictionaries(st.text(alphabet="ab.\\e ", min_size=1, max_size=6), st.text(alphabet="abX", max_size=3), max_size=8))
def test_longest_alias_first(text, mapping):
    assert A.Replacer(mapping).replace(text) == slow(text, mapping)


def test_odd_letters_keep_their_places():
    assert A.Replacer({"host": "H", "é": "e"}).replace("İİ HOSTẞ É ß host") == "İİ Hẞ e ß H"


def test_cases_of_any_size(spark, monkeypatch):
    """Thousands of aliases in one case, keys with quoting marks, one case cut into slices, and rows without a case."""
    monkeypatch.setattr(A, "SLICE_BYTES", 2000)
    rng = random.Random(2)
    many = {f"host-{i:05d}": f"<{i}>" for i in range(10_000)} | {"host-0": "<zero>"}
    maps = {"big": many, "quoted": {"a\\e b": "[q]", "\\q": "[x]", "(.*": "[y]", "": "nothing"}, "plain": {"x": "y"}, "unused": {"k": "v"}}
    texts = {"big": lambda: f"at HOST-{rng.randrange(12_000):05d} and host-0{rng.randrange(9)}", "quoted": lambda: "A\\E b \\Q (.* [.]", "plain": lambda: "xXz",
             "other": lambda: "host-00001 stays", None: lambda: "x stays"}
    rows = [(i, c, None if i % 17 == 3 else texts[c](), {"k": texts[c](), "n": None, "x": "x"} if i % 5 else None)
            for i, c in enumerate(["big"] * 400 + ["quoted", "plain", "other", None] * 10)]
    docs = spark.createDataFrame(rows, "id long, case string, text string, attributes map<string,string>")
    names = spark.createDataFrame([(c, a, p) for c, m in maps.items() for a, p in m.items()], "case string, alias string, pseudonym string")
    found = A.replace_in_cases(docs.withColumn("kind", F.lit(7)), "case", ["text", "attributes"], names)
    assert found.columns == ["id", "case", "text", "attributes", "kind"]
    clean = {c: {a.lower(): p for a, p in m.items() if a} for c, m in maps.items()}
    want = sorted((i, c, slow(t, clean.get(c)), None if m is None else {k: slow(v, clean.get(c)) for k, v in m.items()}, 7) for i, c, t, m in rows)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]) == want
    assert A.replace_in_cases(docs.limit(0), "case", ["text"], names).count() == 0
    assert A.replace_in_cases(docs, "case", ["text"], names.limit(0)).select("text").exceptAll(docs.select("text")).count() == 0


def test_mappings_beside_the_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "KEPT", 3)
    rows = [(i, f"User-{i % 9} on a\\E", {f"user-{i % 9}": f"[{i % 9}]", "a\\e": "q"}) for i in range(60)] + [(90, None, {"a": "b"}), (91, "t", None), (92, "t", {})]
    docs = spark.createDataFrame(rows, "id long, text string, m map<string,string>")
    got = {r.id: r.out for r in docs.select("id", A.replace_simultaneous(F.col("text"), F.col("m")).alias("out")).collect()}
    assert got == {i: f"[{i % 9}] on q" for i in range(60)} | {90: None, 91: None, 92: "t"}


def test_slices_have_tasks_and_texts_travel_once(spark, monkeypatch):
    """One case with most of the text is spread over as many tasks as it has slices, and its texts are in the shuffle once."""
    monkeypatch.setattr(A, "SLICE_BYTES", 200)
    docs = spark.createDataFrame([(i, "big" if i % 5 else "small", f"the word {i} " * 3) for i in range(200)], "id int, case string, text string")
    names = spark.createDataFrame([("big", "THE", "a"), ("small", "word", "b")], "case string, alias string, pseudonym string")
    found = A.replace_in_cases(docs, "case", ["text"], names)
    rows = found.collect()
    assert {r.id: r.text for r in rows} == {i: (f"a word {i} " if i % 5 else f"the b {i} ") * 3 for i in range(200)} and len(rows) == 200
    exchange = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line)
    assert any(int(n) > 20 for n in re.findall(r"\], (\d+)", exchange)), exchange
