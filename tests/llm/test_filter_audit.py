"""Filter interactions against applying the filters one by one in every order."""

import re
from collections import Counter
from itertools import permutations

from alertweft.llm import filter_audit as A
from oracle import compare, connect
from pyspark.sql import types as T

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def slow_fails(rows):
    """Failed filters of every (id, text, part)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = t.encode().split()
        first = least.get(t)
        out.append("".join(c for c, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            re.search("[#$%&*|]", t), first is not None and (i is None or i > first))) if bad))
    return out


def slow_audit(rows, labels):
    """Row by row, every filter in turn."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    fails, out = slow_fails(rows), []
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails) if (p or "") == part]
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                removed = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                all_fails = sum(c in f for _, f in mine)
                shapley[c] += len(removed)
                lines.append((c, (part, "".join(order), step, len(left), len(removed), all_fails - len(removed), sum(f == c for _, f in mine),
                                  sum(i in good for i, _ in removed if i is not None), sum(i in toxic for i, _ in removed if i is not None))))
        out += [(*line, shapley[c]) for c, line in lines]
    return sorted(out)


def test_intervals_cover_every_removal_once():
    for size in (1, 2, 3, 5):
        orders = list(permutations(range(size)))
        cover = Counter((mask, step, rank) for mask, step, first, last in A.intervals(size) for rank in range(first, last))
        assert set(cover.values()) == {1}
        want = {(mask, next(s for s, f in enumerate(order, 1) if mask >> f & 1), rank) for mask in range(1, 1 << size) for rank, order in enumerate(orders)}
        assert set(cover) == want


def test_against_every_order(spark, docs_of):
    many = " ".join(f"word{i}" for i in range(60))
    texts = [many, many, many, None, "", "short", "SHOUT " * 70, many + " #", "a b " * 40, "A$ " * 10, many.upper(), many + " x", "short", " \t" + many, "é" * 30]
    rows = [(i if i % 6 else None, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts * 3)] + [(1, many, "s1"), (1, many, "s1"), (7, "other", "")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (None, 1, 1), (8, 1, 1), (13, 1, 0), (99, 1, 1)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
    docs = spark.createDataFrame(rows, schema)
    for clash in ("id", "part", "mask", "digest", "n", "good", "key", "label_id"):
        docs = docs.withColumn(clash, docs["text"])
    found = A.audit(docs, spark.createDataFrame(labels, LABELS))
    assert found.columns == COLUMNS and sorted(tuple(r) for r in found.collect()) == slow_audit(rows, labels)


def test_empty_tables(spark, docs_of):
    labels = spark.createDataFrame([], LABELS)
    docs = docs_of([(1, "x"), (2, None)])
    assert A.audit(docs.limit(0), labels).count() == 0
    found = A.audit(docs, labels).collect()
    assert len(found) == 1200 and all(r.good_lost == r.toxic_lost == 0 for r in found) and sum(r.removed for r in found) == 240


def test_registered_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    ok, note = compare(entry.queries()["op13_filter_audit"](spark, folder), connect(folder), entry.oracle_sql()["op13_filter_audit"])
    assert ok and "types" not in note, note
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in entry.queries()["op13_filter_audit"](spark, folder).select(*COLUMNS).collect()) == slow_audit(rows, labels)
