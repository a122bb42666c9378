"""Text lines with their 1-based number, and multi-line records, without a global sort.

A file is read in blocks.  Rows of one block carry consecutive ids, so a row's
number is its place in the block plus the lengths of the earlier blocks of the
file.  Those lengths are one small row per block; no text is sorted or shuffled
to number it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from alertweft.session import materialise, ship

ship(__name__)

_CHUNK = ["file", "chunk"]


def _chunked(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )


def _offsets(counts: DataFrame, size: str, name: str) -> DataFrame:
    before = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, line_no, line); blank lines are counted, as a line reader would."""
    rows = _chunked(spark, path, separator)
    counts = rows.groupBy(*_CHUNK).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = _offsets(counts, "_n", "_before").select(*_CHUNK, "_first", "_before")
    numbered = rows.join(starts, _CHUNK)
    return numbered.select("file", "chunk", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")


def blocks(lines: DataFrame, starts_block: Column) -> DataFrame:
    """(file, block_index, first_line, text) records that begin at lines where ``starts_block`` holds.

    Lines before the first start are dropped.  The running count of starts is
    taken inside a chunk and shifted by the starts of earlier chunks, so a
    record may cross a chunk border.
    """
    flagged = lines.withColumn("_s", starts_block.cast("int"))
    per_chunk = flagged.groupBy(*_CHUNK).agg(F.sum("_s").alias("_n"))
    shift = _offsets(per_chunk, "_n", "_before").select(*_CHUNK, "_before")
    inside = W.partitionBy(*_CHUNK).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    indexed = flagged.withColumn("_run", F.sum("_s").over(inside)).join(shift, _CHUNK)
    return _assembled(indexed.select("file", (F.col("_run") + F.col("_before")).alias("block_index"), "line_no", "line"))


def _assembled(members: DataFrame) -> DataFrame:
    return members.filter("block_index > 0").groupBy("file", "block_index").agg(
        F.min("line_no").alias("first_line"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"),
    ).select("file", "block_index", "first_line", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def _pieces(borders: bool):
    """A task's runs of lines between starts: the first and last of every chunk with its counts, or all others."""

    def rows(held: dict, run: int, texts: list[str], offsets: list[int]) -> pa.RecordBatch:
        runs = range(run, run + len(texts))
        fixed = [held["file"], held["chunk"], held["n"], held["m"]]
        return pa.RecordBatch.from_arrays(
            [pa.array([v] * len(texts), t) for v, t in zip(fixed, (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            + [pa.array(runs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], names=["file", "chunk", "n", "m", "run", "offset", "text"])

    def ends(held: dict) -> Iterator[pa.RecordBatch]:
        if held and borders:
            last = "\n".join(held["open"])
            if held["m"] and held["head"] is not None:
                yield rows(held, 0, [held["head"]], [0])
            yield rows(held, held["m"], [last], [held["at"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            files, chunks = batch.column("file"), batch.column("chunk").to_numpy()
            moved = np.flatnonzero((chunks[1:] != chunks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1
            for low, high in zip([0, *moved.tolist()], [*moved.tolist(), batch.num_rows]):
                place = (files[low].as_py(), int(chunks[low]))
                if (held.get("file"), held.get("chunk")) != place:
                    yield from ends(held)
                    held = {"file": place[0], "chunk": place[1], "n": 0, "m": 0, "at": 0, "open": [], "head": None}
                starts = np.flatnonzero(batch.column("_s")[low:high].to_numpy())
                cuts = pa.array(np.unique(np.concatenate([[0], starts, [high - low]])), pa.int32())
                lines = batch.column("line")[low:high].cast(pa.string())
                texts = pc.binary_join(pa.ListArray.from_arrays(cuts, pa.concat_arrays([lines])), "\n").to_pylist()
                if not len(starts) or starts[0]:
                    held["open"].append(texts.pop(0))
                if len(starts):
                    # what was open ends here; the last run of the batch stays open
                    first = "\n".join(held["open"])
                    if held["m"] == 0:
                        held["head"] = first if held["open"] else None
                        done, offsets = texts[:-1], (held["n"] + starts[:-1]).tolist()
                    else:
                        done, offsets = [first, *texts[:-1]], [held["at"], *(held["n"] + starts[:-1]).tolist()]
                    if done and not borders:
                        yield rows(held, max(held["m"], 1), done, offsets)
                    held["m"] += len(starts)
                    held["open"], held["at"] = [texts[-1]], held["n"] + int(starts[-1])
                held["n"] += high - low
        yield from ends(held)

    return run


_PIECE = "file string, chunk long, n long, m long, run long, offset long, text string"


def read_records(spark: SparkSession, path: str, starts_block: Column) -> DataFrame:
    """:func:`blocks` of :func:`read_lines` whose lines stay in the task that reads them.

    Two passes over the files: the first keeps what lies at the borders of a chunk and its
    counts, two records a chunk, which is written once; the second puts together all records that
    begin and end in one chunk.  Only records at a border are grouped across tasks.
    """
    flagged = _chunked(spark, path, None).select("file", "chunk", "line", starts_block.cast("int").alias("_s"))
    edges = materialise(flagged.mapInArrow(_pieces(True), _PIECE), "record-borders")
    stats = edges.groupBy(*_CHUNK).agg(F.max("n").alias("_n"), F.max("m").alias("_m"))
    # a row per chunk of the files
    shift = F.broadcast(_offsets(_offsets(stats, "_n", "_lines"), "_m", "_starts").select(*_CHUNK, "_lines", "_starts"))
    place = ["file", (F.col("run") + F.col("_starts")).alias("block_index"), (F.col("offset") + F.col("_lines") + 1).alias("first_line"), "text"]
    inner = flagged.mapInArrow(_pieces(False), _PIECE).join(shift, _CHUNK).select(*place)
    outer = edges.join(shift, _CHUNK).select(*place).filter("block_index > 0").groupBy("file", "block_index").agg(
        F.min("first_line").alias("first_line"), F.array_sort(F.collect_list(F.struct("first_line", "text"))).alias("_p"))
    return inner.unionByName(outer.select("file", "block_index", "first_line", F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text")))
