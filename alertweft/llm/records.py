"""Token ids in length-delimited binary record files with an offset index.

A data file is a row of frames: length (u64), masked CRC-32C of the length (u32),
payload, masked CRC-32C of the payload (u32), all little-endian.  A payload is
(bytes per token id, 1 if the row has an id, row id as i64, token ids); token ids
take two bytes where all of a record fit, else four.  The index file beside it
holds one entry of fixed size per record (offset, payload length, tokens before it in the
file, tokens, row id), so a record is read by one seek.  The manifest lists the files
of the committed write in order.

Files are written by a Spark data source: a task writes files under names of its
own, and only those whose commit message reached the driver are listed, so tasks
that are lost, repeated or run twice leave nothing a reader would see.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import types
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from alertweft.llm.common import text_bytes
from alertweft.llm.crc32c import masked
from alertweft.session import ship

ship(__name__)

#: bytes of text that make up a data file, and bytes of records that are checked and handed on at a time
FILE_BYTES, STEP_BYTES = 32 << 20, 4 << 20
#: words whose ids a worker remembers before older ones are let go, and words encoded in one call
REMEMBERED, JOINED = 400_000, 1000
#: stands between words that are encoded in one call
MARK, BETWEEN = b"~", b" ~ "
HEAD, HEAD_SIZE = "<BBq", 10
ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("start", "<u8"), ("tokens", "<u8"), ("id", "<i8"), ("known", "u1")])
MANIFEST = "manifest.json"


class Encoder:
    """Token ids of UTF-8 texts, as little-endian u32 bytes.

    ``by_words`` is for tokenizers that drop white space, whose ids of a text are
    those of its words one after the other: a word is encoded once and remembered.
    Words that were not met for a while are forgotten, so memory is bounded.
    """

    def __init__(self, file: str, end: int | None, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(file), by_words
        self.end = b"" if end is None else struct.pack("<I", end)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(f.ids, dtype="<u4").tobytes() for f in found]

    def _words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of every word; words without the mark go through the tokenizer together and are parted at its id."""
        alone = [w for w in words if MARK in w] if self.mark is not None else list(words)
        out = dict(zip(alone, self._ids(alone)))
        plain = list(words - out.keys())
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            (raw,) = self._ids([BETWEEN.join(some)])
            cuts = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark)).tolist()
            apart = [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]
            out.update(zip(some, apart if len(apart) == len(some) else self._ids(some)))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [ids + self.end for ids in self._ids(texts)]
        split = [t.split() for t in texts]  # ASCII white space, which no token spans
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = set().union(*split) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.known.update(self._words(new - again))
        return [b"".join(map(self.known.__getitem__, words)) + self.end for words in split]


def worker_encoder(*how) -> Encoder:
    """The encoder of this Python worker, with the words it has met in earlier tasks.

    Every task brings this module's code anew, so the encoder is kept among the loaded modules.
    """
    kept = sys.modules.setdefault("alertweft-worker-encoders", types.ModuleType("alertweft-worker-encoders")).__dict__
    if how not in kept.get("encoders", {}):
        kept["encoders"] = {how: Encoder(*how)}
    return kept["encoders"][how]


def _cut(sizes: list[int], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about STEP_BYTES, one row at least."""
    first = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > STEP_BYTES:
            yield batch.slice(first, at - first)
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def storage(path: str):
    """(file system, path in it) of a path or URI any worker can reach."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    records: int
    tokens: int


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, tokenizer: str, end: int | None, by_words: bool):
        self.path, self.how = path, (tokenizer, end, by_words)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = storage(self.path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:07d}-{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        encoder, offset, start, records = worker_encoder(*self.how), 0, 0, 0
        with files.open_output_stream(f"{folder}/{name}.rec") as data, files.open_output_stream(f"{folder}/{name}.idx") as index:
            for batch in iterator:
                for some in _cut(pc.binary_length(batch.column("text")).to_pylist(), batch):
                    payloads, tokens = [], []
                    for row, raw in zip(some.column("id").to_pylist(), encoder.encode(some.column("text").to_pylist())):
                        ids = np.frombuffer(raw, "<u4")
                        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
                        payloads.append(struct.pack(HEAD, width, row is not None, row or 0) + ids.astype(f"<u{width}").tobytes())
                        tokens.append(len(ids))
                    sizes = np.fromiter(map(len, payloads), np.uint64, len(payloads))
                    lengths = [struct.pack("<Q", n) for n in sizes.tolist()]
                    sums = zip(masked(lengths).astype("<u4"), masked(payloads).astype("<u4"))
                    data.write(b"".join(x for n, p, (a, b) in zip(lengths, payloads, sums) for x in (n, a.tobytes(), p, b.tobytes())))
                    entries = np.zeros(len(payloads), ENTRY)
                    entries["size"], entries["tokens"] = sizes, tokens
                    entries["offset"] = offset + np.cumsum(sizes + 16) - (sizes + 16)
                    entries["start"] = start + np.cumsum(tokens) - tokens
                    entries["id"] = [row or 0 for row in some.column("id").to_pylist()]
                    entries["known"] = [row is not None for row in some.column("id").to_pylist()]
                    index.write(entries.tobytes())
                    offset, start, records = offset + int((sizes + 16).sum()), start + sum(tokens), records + len(payloads)
        return Written(part, name, records, start)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = storage(self.path)
        files.create_dir(folder, recursive=True)
        done = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.part)
        with files.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps([[m.name, m.records, m.tokens] for m in done]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest nothing that was written counts."""


@dataclass
class FilePart(InputPartition):
    name: str
    start: int


class RecordReader(DataSourceReader):
    def __init__(self, path: str, only_index: bool):
        self.path, self.only_index = path, only_index

    def partitions(self) -> list[FilePart]:
        files, folder = storage(self.path)
        with files.open_input_stream(f"{folder}/{MANIFEST}") as source:
            listed = json.loads(source.read())
        before = np.cumsum([0, *[tokens for _, _, tokens in listed]]).tolist()
        return [FilePart(name, start) for (name, _, _), start in zip(listed, before)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, folder = storage(self.path)
        with files.open_input_stream(f"{folder}/{partition.name}.idx") as source:
            index = np.frombuffer(source.read(), ENTRY)
        keys = [pa.array(index["id"].astype("i8"), mask=index["known"] == 0), pa.array(index["start"].astype("i8") + partition.start),
                pa.array(index["tokens"].astype("i8"))]
        if self.only_index:
            rest = [pa.array([partition.name] * len(index), pa.string()), pa.array(index["offset"].astype("i8")), pa.array(index["size"].astype("i8"))]
            yield pa.RecordBatch.from_arrays([*keys, *rest], names=["id", "start", "n_tokens", "file", "offset", "size"])
            return
        with files.open_input_stream(f"{folder}/{partition.name}.rec") as source:
            for some in _cut(index["size"].tolist(), pa.RecordBatch.from_arrays(keys, names=["id", "start", "n_tokens"])):
                frames = []
                for _ in range(some.num_rows):
                    head = source.read(12)
                    frames.append(head + source.read(struct.unpack_from("<Q", head)[0] + 4 if len(head) == 12 else 0))
                rows, ids = unframe(frames, partition.name)
                if rows != some.column(0).to_pylist() or [len(x) // 4 for x in ids] != some.column(2).to_pylist():
                    raise ValueError(f"{partition.name}: records and index differ")
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"])


def unframe(frames: list[bytes], name: str) -> tuple[list[int | None], list[bytes]]:
    """(row ids, token ids as little-endian u32 bytes) of whole frames; a wrong length or checksum is an error."""
    heads = [f[:8] for f in frames]
    payloads = [f[12:-4] for f in frames]
    whole = all(len(f) >= 16 + HEAD_SIZE and struct.unpack("<Q", h)[0] == len(p) for f, h, p in zip(frames, heads, payloads))
    if not whole or b"".join(f[8:12] for f in frames) != masked(heads).astype("<u4").tobytes():
        raise ValueError(f"{name}: broken record length")
    if b"".join(f[-4:] for f in frames) != masked(payloads).astype("<u4").tobytes():
        raise ValueError(f"{name}: broken record")
    rows, ids = [], []
    for payload in payloads:
        width, known, row = struct.unpack_from(HEAD, payload)
        rows.append(row if known else None)
        ids.append(np.frombuffer(payload, f"<u{width}", offset=HEAD_SIZE).astype("<u4").tobytes())
    return rows, ids


class TokenRecords(DataSource):
    """``token_records``: written from (id long, text binary); read as (id, start, n_tokens, ids), or the index alone."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return "id long, start long, n_tokens long, " + ("file string, offset long, size long" if self._index() else "ids binary")

    def _index(self) -> bool:
        return self.options.get("only", "") == "index"

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], self._index())

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        end = self.options.get("end", "")
        return RecordWriter(self.options["path"], self.options["tokenizer"], int(end) if end else None, self.options.get("by_words", "") == "true")


def in_id_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(id, text) over sorted ranges of about ``file_bytes`` of text: ascending ids, null ids last, ties by text.

    Rows that repeat id and text are spread over ranges by their place in the
    input; they are interchangeable, so the result does not depend on it.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    order: list[Column] = [F.col("id").isNull(), F.col("id"), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order[:3], F.col("place"))
    return ranged.sortWithinPartitions(*order).select("id", "text")


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = None, by_words: bool = False,
          id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text and write the records in ascending order of the ids.

    A null text is empty: its record holds the end id only.  Null ids come last.
    Every row is a record, repeated rows too; rows of one id are ordered by their
    text.  Long texts are one record each and are never cut; a task holds STEP_BYTES of
    text, or one longer text, and its ids at a time.  An empty table writes an empty manifest.  Other
    columns are not read.  ``path`` must be new and within reach of all workers.
    """
    docs.sparkSession.dataSource.register(TokenRecords)
    how = {"tokenizer": tokenizer, "end": "" if end is None else str(end), "by_words": str(by_words).lower()}
    rows = in_id_order(docs, id_col, text_col, file_bytes).select("id", F.coalesce(text_bytes("text"), F.lit(b"")).alias("text"))
    rows.write.format("token_records").options(**how).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every record in written order, all checksums verified; one task per file."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").load(path)


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, parts: int = 200) -> DataFrame:
    """The records of ``read`` in a random order over the whole corpus, fetched by their offsets.

    Only index entries are shuffled and sorted; a task then seeks each of its records.
    """
    spark.dataSource.register(TokenRecords)
    entries = spark.read.format("token_records").option("only", "index").load(path)
    place = F.xxhash64("file", "offset", F.lit(seed))
    dealt = entries.withColumn("place", place).repartition(parts, "place").sortWithinPartitions("place", "file", "offset").drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = storage(path)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for some in _cut(batch.column("size").to_pylist(), batch):
                frames = []
                for name, offset, size in zip(*(some.column(c).to_pylist() for c in ("file", "offset", "size"))):
                    if len(opened) > 64 and name not in opened:
                        opened.pop(next(iter(opened))).close()
                    source = opened.get(name) or opened.setdefault(name, files.open_input_file(f"{folder}/{name}.rec"))
                    source.seek(offset)
                    frames.append(source.read(size + 16))
                ids = unframe(frames, path)[1]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return dealt.mapInArrow(run, "id long, start long, n_tokens long, ids binary")
