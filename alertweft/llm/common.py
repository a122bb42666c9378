"""Shared pieces: sorted-stream grouping inside tasks, union-find, and components on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertweft.session import materialise, ship

ship(__name__)

#: largest number a signed row id can take; rows without an id sort behind all others
LAST = (1 << 63) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text column; a null text stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def whole_row(df: DataFrame, *without: str) -> Column:
    """The columns of ``df`` as one struct, out of the way of columns an operator adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without])


def bucket_of(column: Column, mod: int) -> Column:
    """``crc32(id as text) mod n``, the fold a labelled row belongs to (null id: null)."""
    return (F.crc32(column.cast("string").cast("binary")) % mod).cast("int")


def binary_view(column: pa.Array) -> list[bytes | None]:
    return column.to_pylist()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream sorted by integer ``keys`` into one table per key.

    Only the current batch and the group that straddles its end are held, so the
    caller bounds memory by bounding the size of a group.
    """
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        changed[0] = last is not None and tuple(c[0] for c in columns) != last
        cuts = np.flatnonzero(changed).tolist()
        start = 0
        for cut in cuts:
            if cut > start:
                pending.append(batch.slice(start, cut - start))
            if pending:
                yield pa.Table.from_batches(pending)
            pending, start = [], cut
        pending.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if pending:
        yield pa.Table.from_batches(pending)


class Union:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b), root = smallest node reachable.

    Alternating large-star and small-star steps: every round moves each node's
    links to its smallest neighbour, so a few rounds leave one star per
    component.  Each round is two keyed minima with map-side combine and is
    written to the shared folder; nothing but a row count and a checksum of the
    round reaches the driver.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )

    def signature(df: DataFrame) -> tuple:
        mix = F.xxhash64("a", "b")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(mix, 24)), F.bit_xor(mix)).first())

    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small, label)
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
