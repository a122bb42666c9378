"""Substring deduplication: difference-cover anchors, extended to windows.

A window is ``window`` consecutive words of one document.  A word goes when a
window that covers it starts, word for word, in a document with a smaller id too.

Anchors of ``window - period + 1`` words are hashed only at positions whose
remainder modulo the period is in a difference cover: for any two positions some
shift below the period brings both onto the cover, so two equal windows always
hold an equal anchor that both have hashed.  Windows around anchors that more
than one document has are hashed in full and settled by their smallest id.

The work moves in blocks.  A block is a bounded set of documents, chosen by the
hash of id and text, so rows without an id and rows of one id are spread over blocks
too; what it sends away and gets back is packed by hash bucket, once
per block and hash.  A passage that a third of all documents share so costs each
block one entry, and no task holds more than a block or a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from alertweft.llm.common import LAST, text_bytes
from alertweft.session import ship

ship(__name__)

#: smallest difference covers by period
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: bytes of an anchor hash and of a window hash that are sent
ANCHOR, WINDOW = 6, 12


class Words:
    """The words of a text and the places where they lie in the joined text."""

    def __init__(self, text: bytes | None):
        words = (text or b"").split()
        self.n = len(words)
        self.joined = b" ".join(words)
        ends = np.fromiter(map(len, words), np.int64, self.n)
        ends = np.cumsum(ends + 1) - 1 if self.n else ends
        self.ends = ends.tolist()
        self.starts = [0, *[e + 1 for e in self.ends[:-1]]] if self.n else []

    def anchors(self, period: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) at the cover positions."""
        at = np.arange(max(0, self.n - length + 1))
        at = at[np.isin(at % period, COVERS[period])]
        joined, starts, ends, last = self.joined, self.starts, self.ends, length - 1
        hashes = np.fromiter((xxh64_intdigest(joined[starts[p] : ends[p + last]]) for p in at.tolist()), np.uint64, len(at))
        return at, hashes

    def candidates(self, at: np.ndarray, window: int, length: int) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at ``at``."""
        marks = np.zeros(self.n + 1, dtype=np.int32)
        np.add.at(marks, np.maximum(at - (window - length), 0), 1)
        np.add.at(marks, at + 1, -1)
        return np.flatnonzero(np.cumsum(marks)[: max(0, self.n - window + 1)])

    def windows(self, at: np.ndarray, window: int) -> np.ndarray:
        """Window hashes as rows of (u64, u32)."""
        joined, starts, ends, last = self.joined, self.starts, self.ends, window - 1
        raw = b"".join([xxh3_128_digest(joined[starts[p] : ends[p + last]])[:WINDOW] for p in at.tolist()])
        return np.frombuffer(raw, dtype=[("a", "<u8"), ("b", "<u4")])

    def kept(self, gone: np.ndarray) -> bytes:
        joined, starts, ends = self.joined, self.starts, self.ends
        return b" ".join([joined[starts[i] : ends[i]] for i in np.flatnonzero(~gone).tolist()])


def _texts(block: pa.Table) -> dict[bytes, list[int]]:
    """Distinct texts of a block with their row numbers."""
    rows: dict[bytes, list[int]] = {}
    for i, text in enumerate(block.column("text").to_pylist()):
        rows.setdefault(text or b"", []).append(i)
    return rows


def _cut(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) of every bucket that has one of the hashes, in order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, at[1:]))) if len(found) else []


def _pack(hashes: np.ndarray) -> bytes:
    """The upper ANCHOR bytes of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - ANCHOR :].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // ANCHOR, 8), dtype=np.uint8)
    wide[:, 8 - ANCHOR :] = np.frombuffer(raw, np.uint8).reshape(-1, ANCHOR)
    return wide.reshape(-1).view("<u8")


def _unpack_all(raws: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[_unpack(r) for r in raws]])


_TOP = np.uint64(((1 << 64) - 1) ^ ((1 << (8 * (8 - ANCHOR))) - 1))


def _block_windows(block: pa.Table, shared: np.ndarray, period: int, window: int):
    """Candidate windows of a block.

    Returns the distinct window hashes in order, the smallest id that has each,
    and per distinct text (words, rows, starts, window numbers).
    """
    length = window - period + 1
    ids = block.column("id").to_numpy()
    texts, hashes, owners, total = [], [], [], 0
    for text, rows in _texts(block).items():
        words = Words(text)
        at, anchor = words.anchors(period, length)
        if len(shared) and len(at):
            anchor = anchor & _TOP
            place = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
            starts = words.candidates(at[shared[place] == anchor], window, length)
        else:
            starts = np.zeros(0, np.int64)
        texts.append((text, rows, starts, total))
        if len(starts):
            hashes.append(words.windows(starts, window))
            owners.append(np.full(len(starts), ids[rows].min()))
            total += len(starts)
    if not total:
        return np.zeros(0, [("a", "<u8"), ("b", "<u4")]), np.zeros(0, np.int64), np.zeros(0, np.int64), texts
    every, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((every["b"], every["a"]))
    ordered = every[order]
    first = np.ones(total, dtype=bool)
    first[1:] = (ordered["a"][1:] != ordered["a"][:-1]) | (ordered["b"][1:] != ordered["b"][:-1])
    number = np.empty(total, dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    return ordered[first], np.minimum.reduceat(owner[order], np.flatnonzero(first)), number, texts


def removed_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, period: int = 7,
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every row.

    A null text has no words.  Rows that repeat an id are one document: they
    take nothing from each other.  A row without an id gives way to every row
    with one and takes nothing from others.  Texts shorter than a window lose
    nothing; other columns are not read; an empty table gives no rows.  The sizes of a block and a bucket are
    bounds on what one task holds, and their numbers follow the bytes of the corpus.
    """
    length = window - period + 1
    if period not in COVERS or length < 1:
        raise ValueError(f"no difference cover for period {period} within {window} words")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, -(-total // 2 // bucket_bytes))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(
        F.pmod(F.xxhash64(key, F.col(text_col)), F.lit(blocks)).alias("block"), key.alias("id"), text_bytes(text_col).alias("text")
    ).repartition("block")

    def send_anchors(block: pa.Table) -> pa.Table:
        each = []
        for text, rows in _texts(block).items():
            found = np.unique(Words(text).anchors(period, length)[1] & _TOP)
            each.append(found if len(rows) < 2 else np.repeat(found, 2))
        values, counts = np.unique(np.concatenate(each), return_counts=True)
        mixed = values >> np.uint64(16)
        out = [(b, _pack(values[at[counts[at] < 2]]), _pack(values[at[counts[at] > 1]])) for b, at in _cut(mixed, buckets)]
        number = block.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([number] * len(out), pa.int64()),
                         "once": pa.array([o[1] for o in out], pa.binary()), "more": pa.array([o[2] for o in out], pa.binary())})

    def find_shared(bucket: pa.Table) -> pa.Table:
        once = [_unpack(x) for x in bucket.column("once").to_pylist()]
        more = [_unpack(x) for x in bucket.column("more").to_pylist()]
        values, counts = np.unique(np.concatenate([*once, *more, *more]), return_counts=True)
        shared = values[counts > 1]
        # what is repeated inside its own block counts twice above, so it is shared everywhere
        out = [_pack(np.concatenate([m, o[np.isin(o, shared, assume_unique=True)]])) for o, m in zip(once, more)]
        return pa.table({"block": bucket.column("block"), "payload": pa.array(out, pa.binary())})

    def send_windows(block: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        if block.num_rows:
            shared = np.sort(_unpack_all(side.column("payload").to_pylist()))
            values, least, _, _ = _block_windows(block, shared, period, window)
            number = block.column("block")[0].as_py()
            out = [(b, number, values[at].tobytes(), least[at].tobytes()) for b, at in _cut(values["a"], buckets)]
        kinds = {"bucket": pa.int64(), "block": pa.int64(), "hashes": pa.binary(), "least": pa.binary()}
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(kinds.items())})

    def settle(bucket: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, [("a", "<u8"), ("b", "<u4")]) for x in bucket.column("hashes").to_pylist()]
        least = np.concatenate([np.frombuffer(x, np.int64) for x in bucket.column("least").to_pylist()])
        every = np.concatenate(hashes)
        order = np.lexsort((every["b"], every["a"]))
        ordered = every[order]
        first = np.ones(len(every), dtype=bool)
        first[1:] = (ordered["a"][1:] != ordered["a"][:-1]) | (ordered["b"][1:] != ordered["b"][:-1])
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(first))
        earlier = np.empty(len(every), dtype=bool)
        earlier[order] = lowest[np.cumsum(first) - 1] < least[order]
        bits = [np.packbits(x).tobytes() for x in np.split(earlier, np.cumsum([len(h) for h in hashes])[:-1])]
        return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "payload": pa.array(bits, pa.binary())})

    def finish(block: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        if block.num_rows:
            ids = block.column("id").to_numpy()
            kind, payload = side.column("bucket").to_pylist(), side.column("payload").to_pylist()
            shared = np.sort(_unpack_all([p for k, p in zip(kind, payload) if k < 0]))
            bits = {k: p for k, p in zip(kind, payload) if k >= 0}
            values, least, number, texts = _block_windows(block, shared, period, window)
            earlier = np.zeros(len(values), dtype=bool)
            for b, at in _cut(values["a"], buckets):
                earlier[at] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(at)).astype(bool)
            for text, rows, starts, offset in texts:
                words = Words(text)
                mine = number[offset : offset + len(starts)]
                done: dict[bytes, tuple] = {}
                for row in rows:
                    hit = starts[earlier[mine] | (least[mine] < ids[row])]
                    if (again := done.get(hit.tobytes())) is None:
                        marks = np.zeros(words.n + 1, dtype=np.int32)
                        np.add.at(marks, hit, 1)
                        np.add.at(marks, hit + window, -1)
                        gone = np.cumsum(marks)[:-1] > 0
                        kept = words.kept(gone) if len(hit) else words.joined
                        again = done[hit.tobytes()] = (words.n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept)
                    out.append((None if ids[row] == LAST else int(ids[row]), *again))
        columns = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        names = list(columns) if with_text else list(columns)[:4]
        return pa.table({n: pa.array([o[i].decode() if n == "kept_text" else o[i] for o in out], columns[n]) for i, n in enumerate(names)})

    anchors = rows.groupBy("block").applyInArrow(send_anchors, "bucket long, block long, once binary, more binary")
    shared = anchors.groupBy("bucket").applyInArrow(find_shared, "block long, payload binary").where("length(payload) > 0")
    windows = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send_windows, "bucket long, block long, hashes binary, least binary"
    )
    settled = windows.groupBy("bucket").applyInArrow(settle, "block long, bucket long, payload binary")
    side = shared.select("block", F.lit(-1).cast("long").alias("bucket"), "payload").unionByName(settled)
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
