"""Held-out accuracy of the two classifiers, the risk estimator, and edge rows."""

import numpy as np
import pytest

from alertweft.llm import convnet, toxicity
from alertweft.llm.queries.op07_convnet import op7_convnet
from alertweft.llm.queries.op08_toxicity import op8_toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, df, target):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", target)
    rows = df.where("held_out").join(labels, "doc_id").collect()
    s, y = np.array([r.score for r in rows]), np.array([r[target] for r in rows])
    rank = s.argsort().argsort()
    ones = y.sum()
    auc = (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    return auc, np.mean([r.predicted == r[target] for r in rows]), df


@pytest.mark.parametrize("run,target,mod,fold", [(op8_toxicity, "toxic", 4, 2), (op7_convnet, "quality", 5, 0)])
def test_held_out(spark, run, target, mod, fold):
    import zlib

    df = run(spark, FOLDER)
    auc, right, _ = held_out(spark, df, target)
    assert auc > 0.97 and right > 0.95, (auc, right)
    assert df.count() == 10_000
    for r in df.limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == fold)


def test_nonnegative_risk_finds_positives_among_unlabelled():
    rng = np.random.default_rng(0)
    pos = (rng.random((300, 20)) < np.where(np.arange(20) < 5, 0.8, 0.2)).astype(np.float32)
    clean = (rng.random((1500, 20)) < 0.2).astype(np.float32)
    w, b = toxicity.fit_nnpu(pos[:100], np.vstack([clean, pos[100:]]), prior=200 / 1700, seed=0)
    hidden, rest = pos[100:] @ w + b, clean @ w + b
    assert (hidden[:, None] > rest[None, :]).mean() > 0.93
    # the risk on clean text stays at or above zero: the fit does not push hidden positives ever further down
    assert np.median(hidden) > np.quantile(rest, 0.9)


def test_toxicity_edge_rows(spark, docs_of):
    docs = docs_of([(i, "you idiot scum" if i % 3 == 0 else f"a plain text number {i}") for i in range(90)]
                   + [(200, None), (201, ""), (None, "idiot scum"), (202, "word " * 100_000 + "idiot scum"), (0, "you idiot scum")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(1, 1, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    score = {r.doc_id: r.score for r in rows}
    assert score[3] > 0.5 > 0.3 > score[4] and score[202] >= 0.3 and score[None] >= 0.3 and score[200] == score[201] < 0.3
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(90) if i % 3} | {200, 201}
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).collect() == [] and toxicity.drop_toxic(docs, empty).count() == docs.count()


def test_convnet_edge_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "x"), (None, "abc"), (4, "long text. " * 60_000), (3, "x")])
    model = convnet.train(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = convnet.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert convnet.score(docs.limit(0), model).collect() == []


def test_chunks_cover_the_whole_text():
    """A response anywhere changes the score, and grouping long texts changes nothing."""
    table = convnet.byte_vectors()
    rng = np.random.default_rng(2)
    signs = np.zeros((convnet.WIDTH, table.shape[1], 1), dtype=np.float32)
    signs[:, 6] = 1  # counts symbols
    model = convnet.Model(signs.reshape(-1, 1), np.zeros(1, np.float32), np.ones(1), np.ones(1), 0.0)
    text = bytes(rng.integers(97, 123, size=convnet.STEP * 3 * convnet.GROUP + 777).astype(np.uint8))
    base = model.logit(text, table)
    whole = convnet.GROUP
    try:
        convnet.GROUP = 10**6
        assert abs(model.logit(text, table) - base) < 1e-4
    finally:
        convnet.GROUP = whole
    for at in (0, 5000, len(text) // 2, len(text) - 40):
        changed = text[:at] + b"&%&%&%&%&%&%&%&%&%&%" + text[at + 20 :]
        assert abs(model.logit(changed, table) - base) > 1e-7
