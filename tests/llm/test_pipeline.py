"""Every stage of the pipeline against plain Python on its own input."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline as P
from alertweft.llm import toxicity
from alertweft.session import materialise
from test_near_copies import slow_kept

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages(spark):
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")

    clean = materialise(stages["toxicity"](spark, docs, FOLDER), "t")
    model = toxicity.train(docs, labels)
    texts = docs.select("doc_id", "text").collect()
    keep = {r.doc_id for r, p in zip(texts, model.probabilities([r.text.encode() for r in texts])) if p < 0.3}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == keep

    single = materialise(stages["simhash_near_dedup"](spark, clean, FOLDER), "t")
    want = slow_kept({r.doc_id: r.text for r in clean.collect()})
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(want)

    safe = materialise(stages["benchmark_decontamination"](spark, single, FOLDER), "t")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in single.collect() if any(x in r.text for x in items)}
    left = {r.doc_id for r in safe.collect()}
    assert safe.columns == docs.columns and not left & whole
    assert len({r.doc_id for r in single.collect()} - left - whole) <= 1

    mixed = materialise(stages["source_mixing"](spark, safe, FOLDER), "t")
    sizes = Counter()
    for r in safe.collect():
        sizes[r.source if r.source in P.WEIGHTS else "*"] += len(r.text.encode()) + 1
    expected = Counter()
    for r in safe.collect():
        kind = r.source if r.source in P.WEIGHTS else "*"
        rate = P.WEIGHTS.get(kind, P.REST) * sum(sizes.values()) / sizes[kind]
        u, k, c = int(hashlib.md5(f"mix|{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52), 0, math.exp(-rate)
        while c <= u:
            k += 1
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        if k:
            expected[(r.doc_id, r.text, r.lang, r.source, r.n_chars)] = k
    assert mixed.columns == docs.columns and rows_of(mixed) == expected

    placed = stages["sharding"](spark, mixed, FOLDER)
    assert placed.columns == [*docs.columns, "shard", "slot"] and rows_of(placed) == expected
    slots = defaultdict(list)
    for r in placed.collect():
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(P.SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_applies_all_stages(spark):
    found = P.run(spark, FOLDER)
    assert {"shard", "slot"} <= set(found.columns) and found.count() > 0 and P.ORACLE_SQL is None


def test_empty_and_odd_documents(spark, docs_of):
    docs = docs_of([(None, None), (1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (4, "w " * 30_000)])
    for rows in (docs.limit(0), docs):
        at = rows
        for name, stage in P.STAGES:
            at = materialise(stage(spark, at, FOLDER), name)
        assert {"shard", "slot"} <= set(at.columns)
