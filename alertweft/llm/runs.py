"""Periodic runs of words: stretches that repeat a block of words four times or more.

Short periods are found by comparing the words with themselves at every short
lag.  Longer ones go by scales: the scale ``k`` looks for periods from k to 2k - 1.
Each position carries a hash of its next k words, and the least hash of every window of
k / 2 positions is kept as a minimizer.  Equal windows choose alike, so inside a
run minimizers repeat at the distance of its period, and equal ones k to 2k - 1
apart seed a comparison of the words themselves, extended both ways.

No run is lost.  Positions whose k words and the period before them lie inside a run of
a period of at most k / 4, all known from lower scales, take no part: they would choose
the same hash over and over.  What is left of one hash lies more than k / 4 apart, which
bounds the pairs, and any stretch of one primitive period of k words or more has such
a position.  In a run of four periods there is therefore a window whose minimizer
repeats one period on.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from alertweft.llm.common import text_bytes
from alertweft.session import ship

ship(__name__)

#: first scale; shorter periods are compared lag by lag
FIRST = 16
#: least length of a run, and least number of periods in it
LEAST, TIMES = 6, 4
#: bytes of text looked at together
STEP_BYTES = 2 << 20
_NONE = np.uint64((1 << 64) - 1)


def _combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two blocks of the same length from their hashes."""
    z = left * np.uint64(0x9E3779B97F4A7C15) + right
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def _longer(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from those of k words; behind the end there are zeros."""
    return _combine(hashes, np.concatenate([hashes[k:], np.zeros(min(k, len(hashes)), np.uint64)]))


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of some window that holds them; ``window`` is a power of two."""
    least, step = hashes.copy(), 1
    while step < window:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    chosen, step = least, 1
    while step < window:
        chosen[step:] = np.maximum(chosen[step:], chosen[:-step].copy())
        step *= 2
    return np.flatnonzero((chosen == hashes) & (hashes != _NONE))


def seeds(hashes: np.ndarray, at: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """(distance, position) of all pairs of equal hashes at distances from ``low`` to ``high`` - 1."""
    order = np.argsort(hashes[at], kind="stable")
    value, place = hashes[at][order], at[order]
    out, lag = [], 1
    while lag < len(at):
        apart = place[lag:] - place[:-lag]
        near = (value[lag:] == value[:-lag]) & (apart < high)
        if not near.any():
            break
        fit = np.flatnonzero(near & (apart >= low))
        out.extend(zip(apart[fit].tolist(), place[fit].tolist()))
        lag += 1
    return sorted(out)


def _common(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on; i < j."""
    done, step = 0, 64
    while True:
        right = words[j + done : j + done + step]
        differ = np.flatnonzero(words[i + done : i + done + len(right)] != right)
        if len(differ):
            return done + int(differ[0])
        done += len(right)
        if len(right) < step:
            return done
        step *= 2


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of word numbers, in order.

    ``words`` holds documents of ``sizes`` words, each followed by a number that
    occurs nowhere else, so no run leaves its document.
    """
    found: dict[tuple[int, int], int] = {}  # the least period of a stretch is met first
    for lag in range(1, min(FIRST, len(words))):
        same = np.flatnonzero(words[lag:] == words[:-lag])
        if len(same):
            cut = np.flatnonzero(np.diff(same) != 1)
            first, last = same[np.concatenate([[0], cut + 1])], same[np.concatenate([cut, [len(same) - 1]])]
            fit = last - first + 1 >= max(LEAST, TIMES * lag) - lag
            for start, end in zip(first[fit].tolist(), (last[fit] + 1 + lag).tolist()):
                found.setdefault((start, end), lag)
    origin, backwards = np.arange(len(words)), None
    hashes, k = words.astype(np.uint64), 1
    while True:
        keep = sizes >= TIMES * max(k, FIRST)
        if not keep.any():
            return sorted((start, end, period) for (start, end), period in found.items())
        if not keep.all():
            mask = np.repeat(keep, sizes + 1)
            words, origin, hashes, sizes = words[mask], origin[mask], hashes[mask], sizes[keep]
        if k >= FIRST:
            free = hashes.copy()
            for (start, end), period in found.items():
                if period <= k // 4 and end - k >= start + period:
                    at = int(np.searchsorted(origin, start))
                    if at < len(origin) and origin[at] == start:
                        free[at + period : at + end - k - start + 1] = _NONE
            backwards, last, reached = words[::-1], 0, -1
            for period, at in seeds(free, minimizers(free, k // 2), k, 2 * k):
                if period == last and at < reached:
                    continue  # inside what was just compared
                end, size = at + _common(words, at, at + period), len(words)
                start = at - _common(backwards, size - at - period, size - at)
                last, reached = period, end
                if end - start >= (TIMES - 1) * period:
                    first = int(origin[start])
                    found.setdefault((first, first + end + period - start), period)
        hashes, k = _longer(hashes, k), 2 * k


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, word numbers with a separator behind each text, sizes)."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [t.split() for t in texts]  # on bytes: ASCII white space only
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.empty(int(sizes.sum()) + len(split), dtype=np.int64)
    at = 0
    for i, words in enumerate(split):
        codes[at : at + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        codes[at + len(words)] = -1 - i
        at += len(words) + 1
    return split, codes, sizes


def describe(texts: list[bytes]) -> list[dict]:
    """For every text its runs and digests, see ``periodic_runs``."""
    split, codes, sizes = _numbered(texts)
    runs = find_runs(codes, sizes)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.searchsorted(begins, [r[0] for r in runs], side="right") - 1
    mine: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for (start, end, period), doc in zip(runs, owner.tolist()):
        at = int(begins[doc])
        mine[doc].append((start - at, end - start, period))
    out = []
    for doc, words in enumerate(split):
        own = sorted(mine.get(doc, []), key=lambda r: (r[0], r[2]))
        kept = words
        if own:
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, period in own:
                marks[start + period] += 1
                marks[start + length] -= 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]
        start, length, period = max(own, key=lambda r: (r[1], -r[0], -r[2])) if own else (None, None, None)
        text = b" ".join(kept)
        out.append({
            "n_words": len(words), "n_runs": len(own), "start": start, "length": length, "period": period,
            "exponent_milli": 1000 * length // period if own else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(text).hexdigest(),
            "runs": [{"start": s, "length": n, "period": p} for s, n, p in own], "collapsed": text})
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs][, collapsed]) of every row.

    A run is a stretch of consecutive words with least period q, of at least
    max(6, 4 q) words, that no neighbour extends.  The four numbers are those of the
    longest run (ties: least start, then period) and null without a run;
    ``runs`` lists all by start and period, and ``collapsed`` is the text with every run
    cut to its first period, words joined by one space.

    A null or empty text has no words and no run.  Rows are judged one by one, so null and
    repeated ids, repeated rows and empty tables need no rule; other columns are
    not read.  Texts are taken whole: a task holds about STEP_BYTES of text
    or one longer text, with some hundred bytes per word.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(text_bytes(text_col), F.lit(b"")).alias("text"))
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    kinds = {n: T.LongType() for n in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")}
    kinds |= {"runs_sha256": T.StringType(), "collapsed_sha256": T.StringType()}
    kinds |= {"runs": run_type} if with_runs else {}
    kinds |= {"collapsed": T.StringType()} if with_text else {}
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), *(T.StructField(n, t) for n, t in kinds.items())])
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), run_type: pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))}

    def batch_of(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        found = describe(texts)
        values = [[f[n].decode("utf-8", "replace") if n == "collapsed" else f[n] for f in found] for n in kinds]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(v, arrow[t]) for v, t in zip(values, kinds.values()))], names=["id", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, texts = 0, 0, []
            for at, text in enumerate(batch.column(1)):
                raw = text.as_py()
                if texts and held + len(raw) > STEP_BYTES:
                    yield batch_of(batch.column(0).slice(first, at - first), texts)
                    first, held, texts = at, 0, []
                held += len(raw)
                texts.append(raw)
            if texts:
                yield batch_of(batch.column(0).slice(first), texts)

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
