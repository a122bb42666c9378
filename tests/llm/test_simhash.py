"""SimHash classes against brute force."""

import random

from xxhash import xxh64_intdigest

from alertweft.llm import simhash
from alertweft.llm.queries.op01_simhash import op1_simhash


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius=2):
    """prints: list of (id, fp) -> component id per row."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            best[find(i)] = min(best.get(find(i), key), key)
    return [best.get(find(i)) for i in range(len(prints))]


def test_fingerprints_link_components(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in texts]
    want = {(k, f"{fp:016x}", c) for (k, fp), c in zip(prints, slow_classes(prints))}
    assert {tuple(r) for r in op1_simhash(spark, folder).collect()} == want


def test_dense_shards_are_cut_into_trees(spark):
    """Fingerprints packed into few bits give shards far above the tree size."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << b for b in rng.sample(range(0, 60, 4), rng.randint(0, 9))) for _ in range(150)}
                  | {rng.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for size in (4, 2048):
        found = simhash.components(simhash.links(fps, 2, tree_size=size), "t")
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in found.collect()}
        mine = {}
        for v in values:
            mine.setdefault(roots.get(v, v), set()).add(v)
        theirs = {}
        for v, c in zip(values, slow_classes([(i, v) for i, v in enumerate(values)])):
            theirs.setdefault(c, set()).add(v)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_edge_rows(spark, docs_of):
    """Null, empty and long texts, repeated rows, a null id, clashing extra columns, an empty table."""
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    docs = docs_of([(4, None), (3, ""), (9, " \t\n"), (5, "One two"), (5, "One two"), (2, "one TWO"), (None, "one two"),
                    (7, long), (8, long), (11, "A b c"), (None, "only here without an id")])
    rows = simhash.near_duplicates(docs).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in rows if r.component_id is not None)
    assert got == [(-1, 2), (2, 2), (3, 3), (4, 3), (5, 2), (5, 2), (7, 7), (8, 7), (9, 3), (11, 11)]
    assert [r.doc_id for r in rows if r.component_id is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_shard_masks_cover_every_pair():
    from itertools import combinations

    masks = simhash.shard_masks(2)
    for pair in combinations(range(64), 2):
        flipped = sum(1 << b for b in pair)
        assert any(m & flipped == 0 for m in masks)
