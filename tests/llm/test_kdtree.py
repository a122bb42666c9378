"""K-d shards against a driver-side tree over the same keys."""

import zlib
from collections import Counter, defaultdict

import pytest

from alertweft.llm import kdtree
from alertweft.llm.queries.op03_kdtree import op3_kdtree


def slow(rows, shards):
    """rows: (size, keys) -> shard per row."""
    out = [0] * len(rows)

    def cut(at, first, count):
        if count == 1 or not at:
            for i in at:
                out[i] = first
            return
        wide = [(max(rows[i][1][d] for i in at) >> kdtree.TIE) - (min(rows[i][1][d] for i in at) >> kdtree.TIE) for d in range(3)]
        d, left = wide.index(max(wide)), count // 2
        weight = defaultdict(int)
        for i in at:
            weight[rows[i][1][d]] += rows[i][0]
        aim, below = sum(weight.values()) * left / count, 0
        for key in sorted(weight):
            if below + weight[key] >= aim:
                edge = key if below + weight[key] - aim <= aim - below else key - 1
                break
            below += weight[key]
        cut([i for i in at if rows[i][1][d] <= edge], first, left)
        cut([i for i in at if rows[i][1][d] > edge], first + left, count - left)

    cut(list(range(len(rows))), 0, shards)
    return out


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in op3_kdtree(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        raw = text.encode()
        assert (got[k].size, got[k].text_crc32, got[k].law, got[k].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    slots = defaultdict(list)
    total = Counter()
    for r in got.values():
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / 16
    assert max(abs(v - mean) for v in total.values()) < 4 * max(r.size for r in got.values()) / 2 + 16


@pytest.mark.parametrize("shards", [16, 7])
def test_tree_is_the_exact_one(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    meta = kdtree.Metadata().table(docs)
    rows = meta.collect()
    want = slow([(r._size, (r._k0, r._k1, r._k2)) for r in rows], shards)
    got = {r.doc_id: r.shard for r in kdtree.assign(docs, shards=shards).collect()}
    assert [got[r._id] for r in rows] == want


def test_edge_rows(spark, docs_of):
    docs = docs_of([(None, None), (1, None), (2, ""), (3, "é" * 50_000), (4, "same"), (4, "same"), (5, "same"), (None, "x")]).withColumnRenamed("n", "slot")
    found = kdtree.assign(docs, shards=4).collect()
    assert len(found) == 8 and {r.shard for r in found} <= {0, 1, 2, 3}
    assert sorted(r["size"] for r in found) == [1, 1, 1, 2, 5, 5, 5, 100_001]
    whole = kdtree.shard_documents(docs, shards=None, target_bytes=20_000)
    assert whole.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"] and whole.count() == 8
    assert kdtree.assign(docs.limit(0)).collect() == [] and kdtree.shard_documents(docs.limit(0)).count() == 0
    same = docs_of([(i, "t") for i in range(400)])
    counts = Counter(r.shard for r in kdtree.assign(same, shards=8).collect())
    assert set(counts.values()) == {50}


def test_no_python_in_the_plan(spark):
    plan = op3_kdtree(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
