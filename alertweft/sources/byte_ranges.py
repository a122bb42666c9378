"""Files by byte range: lines and records with their place, and hashes of ranges and whole files.

A range is a piece of a file that one task reads; a task may read several small ones.  A line belongs to the range
its first byte lies in; its reader goes past the border to the line's end, and
the next range's reader skips to the first line that starts in its own range.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from alertweft.session import ship

ship(__name__)

#: bytes of a range, of the small ranges one task takes, of what a reader hands on at a time, and of a step of hashing
RANGE_BYTES, TASK_BYTES, BATCH_BYTES, STEP_BYTES = 64 << 20, 8 << 20, 4 << 20, 8 << 20
LINES = "file string, chunk bigint, nth bigint, byte_start bigint, byte_end bigint, raw binary"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def listed(path: str) -> list[tuple[str, str, int]]:
    """(name, path in its file system, bytes) of the files at or below ``path``, but those with a leading ``_`` or ``.``."""
    system, root = located(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    # the file systems leave the scheme out of their paths; names keep it, so that they can be opened anywhere
    scheme = "" if isinstance(system, fs.LocalFileSystem) else path.rstrip("/").removesuffix(root.rstrip("/"))
    return sorted((scheme + f.path, f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Range:
    file: str
    place: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges in file order that one task reads one after the other."""

    ranges: list[Range]


def _dealt(ranges: list[Range]) -> list[Ranges]:
    """Neighbouring ranges put together up to ``TASK_BYTES``; a range of that size or more is a task of its own."""
    tasks, held = [], 0
    for one in ranges:
        size = one.end - one.start
        if not tasks or held + size > TASK_BYTES:
            tasks.append(Ranges([]))
            held = 0
        tasks[-1].ranges.append(one)
        held += size
    return tasks


class RawLinesReader(DataSourceReader):
    """A task per range, or per several small ones; files are listed by the driver, as for Spark's own readers."""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Ranges]:
        return _dealt([Range(name, place, start, min(start + self.range_bytes, size)) for name, place, size in listed(self.path)
                       for start in range(0, size, self.range_bytes)]) or [Ranges([])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for _, mine in groupby(part.ranges, key=lambda r: r.place):
            for row in self._lines(list(mine)):
                rows.append(row)
                held += len(row[-1])
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _lines(self, ranges: list[Range]) -> Iterator[tuple]:
        """Lines of neighbouring ranges of one file, which is opened once and read on from range to range."""
        system = located(self.path)[0]
        with system.open_input_file(ranges[0].place) as native, io.BufferedReader(native, 1 << 20) as handle:
            at = ranges[0].start
            if at:
                # the byte before tells whether a line starts at the border
                handle.seek(at - 1)
                at -= 1
                while at < ranges[-1].end:
                    piece = handle.readline(1 << 16)
                    at += len(piece)
                    if not piece or piece.endswith(b"\n"):
                        break
            for one in ranges:
                nth = 0
                while at < one.end:
                    raw = handle.readline()
                    if not raw:
                        break
                    nth += 1
                    yield one.file, one.start, nth, at, at + len(raw), raw
                    at += len(raw)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "chunk", "nth", "byte_start", "byte_end", "raw"])


class RawLines(DataSource):
    """Lines of files as bytes; options ``path`` and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "raw_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> RawLinesReader:
        return RawLinesReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def raw_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, chunk, nth, byte_start, byte_end, raw, line_no) of every line of the files at or below ``path``.

    ``raw`` holds the line's bytes with its end (``\\n``, or nothing at the end of
    a file), ``chunk`` the start of the range it was read in, ``nth`` its place
    there and ``line_no`` its number in the file.  Numbers come from one count per
    range; no line is sorted or shuffled for them.  Empty files have no lines, and
    files named with a leading ``_`` or ``.`` are left out, as Spark's readers do.
    """
    spark.dataSource.register(RawLines)
    lines = spark.read.format("raw_lines").option("path", path).option("range_bytes", range_bytes).load()
    counts = lines.groupBy("file", "chunk").agg(F.max("nth").alias("_n"))
    before = counts.select("file", "chunk", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_before"))
    return lines.join(before, ["file", "chunk"]).withColumn("line_no", F.col("nth") + F.col("_before")).drop("_before")


def _earlier():
    return W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)


def _inside():
    return W.partitionBy("file", "chunk").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)


def byte_records(lines: DataFrame, starts: Column) -> DataFrame:
    """(file, block_index, first_line, byte_start, byte_end, raw) of records that begin at lines where ``starts`` holds.

    ``raw`` are the exact bytes of ``[byte_start, byte_end)``.  Lines before a
    file's first start are dropped.  The running count of starts is taken inside
    a range and shifted by those of earlier ranges, so a record may cross any
    number of borders; one record is held by one task.
    """
    flagged = lines.withColumn("_s", F.coalesce(starts.cast("int"), F.lit(0)))
    counts = flagged.groupBy("file", "chunk").agg(F.sum("_s").alias("_n"))
    shift = counts.select("file", "chunk", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_before"))
    indexed = flagged.withColumn("_run", F.sum("_s").over(_inside())).join(shift, ["file", "chunk"])
    return indexed.withColumn("block_index", F.col("_run") + F.col("_before")).filter("block_index > 0").groupBy("file", "block_index").agg(
        F.min("line_no").alias("first_line"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"),
        F.expr("listagg(raw) within group (order by byte_start)").alias("raw"))


def line_text(raw: Column) -> Column:
    """A line without its end, as text; undecodable bytes become U+FFFD."""
    return F.regexp_replace(F.decode(raw, "UTF-8"), r"[\r\n]+\z", "")


def line_bytes(raw: Column) -> Column:
    """A line without its end, as bytes."""
    return F.substring(raw, F.lit(1), F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[\r\n]+\z", "")))


def csv_records(lines: DataFrame) -> DataFrame:
    """:func:`byte_records` of CSV files with their ``ordinal``, quoted line breaks included; the header is record 1.

    A line starts a record if an even number of quotes stand before it in its
    file, so a file of quoted line breaks splits like any other.  Records without
    any character are not counted, as a CSV reader skips them.
    """
    quoted = lines.withColumn("_q", F.length(F.regexp_replace(F.decode("raw", "ISO-8859-1"), '[^"]', "")).cast("bigint"))
    counts = quoted.groupBy("file", "chunk").agg(F.sum("_q").alias("_n"))
    shift = counts.select("file", "chunk", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_quotes"))
    running = quoted.join(shift, ["file", "chunk"]).withColumn("_open", (F.sum("_q").over(_inside()) - F.col("_q") + F.col("_quotes")) % 2)
    # a blank line between records starts a record, which is not counted
    blank = (F.col("_open") == 0) & F.col("raw").isin(b"\n", b"\r\n")
    starts = F.col("_open") == 0
    found = byte_records(running.withColumn("_blank", blank).filter(~F.col("_blank")).drop("_blank", "_quotes", "_q"), starts)
    return found.withColumnRenamed("block_index", "ordinal")


def _digest(handle, left: int) -> str:
    digest = hashlib.sha256()
    while left:
        step = handle.read(min(STEP_BYTES, left))
        if not step:
            raise OSError("a file became shorter while it was read")
        digest.update(step)
        left -= len(step)
    return digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = size = handle = None
    for batch in batches:
        sizes, digests = [], []
        for wanted, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "byte_start", "byte_end"))):
            if wanted != path:  # rows of one file mostly come together, so it stays open
                if handle is not None:
                    handle.close()
                path, size, handle = wanted, None, None
                if path is not None:
                    system, place = located(path)
                    info = system.get_file_info(place)
                    if info.type == fs.FileType.File:
                        size, handle = info.size, system.open_input_file(place)
            last = size if end is None else end
            sound = handle is not None and start is not None and 0 <= start <= last <= size
            if sound:
                handle.seek(start)
            sizes.append(size)
            digests.append(_digest(handle, last - start) if sound else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                                         [*batch.schema.names, "file_bytes", "sha256"])
    if handle is not None:
        handle.close()


def range_hashes(ranges: DataFrame) -> DataFrame:
    """``ranges`` (file, byte_start, byte_end and other columns) with ``file_bytes`` and ``sha256`` of ``[byte_start, byte_end)``.

    A null end is the end of the file.  Bytes are read and hashed in steps, so a
    range of any length takes the same memory.  A range that is not inside its
    file has no hash, and a file that does not exist has no size either.
    """
    schema = StructType.fromJson(ranges.schema.jsonValue()).add("file_bytes", "long").add("sha256", "string")
    return ranges.mapInArrow(_hashed, schema)
