"""Poisson replication against the SQL twin, against scipy-free inversion, and on edge rows."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from alertweft.llm import mixing
from alertweft.llm.queries.op02_mixing import REST, SQL, WEIGHTS, op2_mixing
from oracle import compare, connect


def test_twin(spark):
    folder = "/root/testdata/sf0.01"
    ok, note = compare(op2_mixing(spark, folder), connect(folder), SQL)
    assert ok, note


def test_counts_invert_the_distribution(spark, docs_of):
    docs = docs_of({i: "x" * (i % 50) for i in range(3000)})
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source if r.source in ("src0", "src1") else "*"] += len(r.text) + 1
    weights, rest, total = {"src0": 3.0, "src1": 0.5}, 0.5, sum(sizes.values())
    got = Counter(r.doc_id for r in mixing.replicate(docs, weights, rest, budget_bytes=2 * total).collect())
    made = Counter()
    for r in docs.collect():
        kind = r.source if r.source in weights else "*"
        rate = weights.get(kind, rest) / 4 * 2 * total / sizes[kind]
        u = int(hashlib.md5(f"mix|{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, c = 0, math.exp(-rate)
        while c <= u:
            k += 1
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        assert got[r.doc_id] == k, (r.doc_id, rate, u)
        made[kind] += k * (len(r.text) + 1)
    assert abs(made["src0"] / sum(made.values()) - 0.75) < 0.03


def test_large_rates_do_not_underflow(spark):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(2000.0)).alias("s")).first().s
    assert abs(steps[-1] - 1) < 1e-9 and abs(next(i for i, c in enumerate(steps) if c > 0.5) - 2000) < 2


def test_edge_rows(spark, docs_of):
    docs = docs_of([(1, None), (1, None), (2, ""), (None, "a"), (None, "b" * 100_000), (3, "c")])
    found = mixing.replicate(docs, {"src0": 1.0}, 50.0, budget_bytes=10_000_000)
    assert found.columns == [c for c in docs.columns if c != "copy"] + ["n_copies", "copy", "shuffle_key"]
    rows = found.collect()
    twins = Counter(r.copy for r in rows if r.doc_id == 1 and r.source == "src0")
    assert rows and all(1 <= r.copy <= r.n_copies for r in rows) and twins
    assert mixing.replicate(docs.limit(0), WEIGHTS, REST).collect() == []
    assert {r.source for r in mixing.replicate(docs, {"src0": 0.0}, 1.0, budget_bytes=10**7).collect()} == {"src1", "src2"} | (
        {None} if any(r.source is None for r in docs.collect()) else set())
