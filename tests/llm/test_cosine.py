"""Cosine links against brute force in numpy."""

import numpy as np
import pytest

from alertweft.llm import cosine
from alertweft.llm.queries.op10_cosine import SQL, op10_cosine
from oracle import compare, connect


def slow(rows, threshold=0.93):
    parent, counts = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, dtype=np.float64)
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is None or units[j] is None or rows[i][2] is None or rows[i][2] != rows[j][2]:
                continue
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                counts[i] += 1
                counts[j] += 1
                parent[find(i)] = find(j)
    best = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            best[find(i)] = min(best.get(find(i), key), key)
    return sorted((-1 if k is None else k, counts[i], -1 if best.get(find(i)) is None else best[find(i)]) for i, (k, _, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in df.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    ok, note = compare(op10_cosine(spark, folder), connect(folder), SQL)
    assert ok, note


@pytest.mark.parametrize("tile", [7, 1024])
def test_tiles_and_bad_vectors(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(4, 20)) + 0.5
        for i in range(60):
            v = centres[i % 4] + rng.normal(size=20) * rng.choice([0.02, 0.2, 0.45])
            rows.append([len(rows), [float(np.float32(x)) for x in v], label])
    for _ in range(15):
        rows.append([len(rows), list(rows[3][1]), 0])
    for v in (None, [], [0.0] * 20, [float("nan")] + [1.0] * 19, [None] + [1.0] * 19, [float("inf")] * 20, [1.0, 2.0], [1.0, 2.1], [-0.0, 3.0], [0.0, 3.0]):
        rows.append([len(rows), v, 1])
    rows.append([None, list(rows[5][1]), 0])
    rows.append([5, list(rows[5][1]), 0])
    df = spark.createDataFrame([tuple(r) for r in rows], "vec_id long, embedding array<float>, label int")
    for name in ("key", "weight", "d", "cell", "part", "first", "root", "vector", "id"):
        df = df.withColumn(name, df["label"])
    found = cosine.near_duplicates(df, tile=tile)
    assert got(found) == slow(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found.collect())
    assert cosine.near_duplicates(df.limit(0)).collect() == []
