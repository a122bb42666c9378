"""Periodic runs against a brute-force search over all periods, and the registered query against plain Python."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from alertweft.llm import runs

FOLDER = "/root/testdata/sf0.001"


def slow_runs(words):
    """(start, length, period) of all runs: every period, every maximal stretch, least period of each stretch."""
    found, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def slow_row(text):
    words = [w for w in (text or "").encode().split()]
    found = slow_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    return (len(found), *top, 1000 * top[1] // top[2] if found else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def fast(docs):
    """Runs of several lists of numbers, found together."""
    sizes = np.array([len(d) for d in docs])
    codes = np.concatenate([np.array([*d, -1 - i], dtype=np.int64) for i, d in enumerate(docs)])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = [[] for _ in docs]
    for start, end, period in runs.find_runs(codes, sizes):
        doc = int(np.searchsorted(begins, start, side="right")) - 1
        out[doc].append((start - int(begins[doc]), end - start, period))
    return [sorted(o) for o in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 70), st.integers(1, 9), st.integers(0, 10**6)), min_size=1, max_size=6))
def test_blocks_repeated(parts):
    """Blocks over few letters, repeated, so that runs lie inside and beside runs of other periods."""
    doc = []
    for letters, size, times, seed in parts:
        rng = random.Random(seed)
        block = [rng.randrange(letters) for _ in range(size)]
        doc += block * times + block[: rng.randrange(size)]
    assert fast([doc]) == [slow_runs(doc)]


def test_nested_and_long_periods():
    rng, docs = random.Random(5), []
    for period in (1, 2, 15, 16, 17, 31, 32, 33, 63, 64, 100, 128, 200):
        for kind in range(4):
            block = {0: [rng.randrange(1000) for _ in range(period)], 1: [0] * (period - 1) + [1], 2: ([0, 1, 2] * period)[:period],
                     3: ([0] * 9 + [1] * 4) * (period // 13) + [7] * (period % 13)}[kind]
            docs.append([9, 9, 8] + block * 4 + block[: period // 2] + [5] + block * 3 + [6] + (block * 5)[1:])
            docs.append((block * 4)[:-1])  # one word short
    assert fast(docs) == [slow_runs(d) for d in docs]


def test_seeds_stay_few():
    """Runs of short periods choose no minimizers at higher scales, so pairs do not grow with their square."""
    words = np.array(([1, 2, 3] * 20_000) + [-1], dtype=np.int64)
    hashes, k = words.astype(np.uint64), 1
    while k < 64:
        hashes, k = runs._longer(hashes, k), 2 * k
    hashes[3 : 60_000 - 64 + 1] = runs._NONE
    assert len(runs.seeds(hashes, runs.minimizers(hashes, 32), 64, 128)) < 100
    assert runs.find_runs(words, np.array([60_000])) == [(0, 60_000, 3)]


def test_edge_cases(spark, docs_of):
    block = " ".join(f"w{i}" for i in range(37))
    docs = docs_of([(None, None), (1, ""), (2, " \t\n"), (3, "x " * 5), (4, "x " * 6), (4, "x " * 6), (None, "A a A a A a A a A"),
                    (5, f"{block} " * 400), (6, "a a " * 7), (7, "x\r\nx\x0bx\x0cx x\tx y")])
    found = runs.periodic_runs(docs, with_runs=True, with_text=True)
    rows = {(r.doc_id, t.text): r for r, t in zip(found.collect(), docs.collect())}
    assert len(rows) == 9 and found.count() == 10
    for (_, text), r in rows.items():
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == slow_row(text)
    assert rows[5, f"{block} " * 400].collapsed == block and rows[None, "A a A a A a A a A"].runs[0].period == 2
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = set()
    for doc_id, text in texts.items():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want.add((doc_id, *slow_row(b" ".join(words).decode())))
    found = entry.queries()["op12_runs"](spark, FOLDER)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(texts) and set(rows) == want and sum(r[1] > 0 for r in rows) > 5
