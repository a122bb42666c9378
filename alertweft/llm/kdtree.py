"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

A node of the tree holds the rows of one or more shards.  It is cut along its
widest dimension where the bytes below the cut match the shards on that side.
The cut is found by histograms: the key range of every open node is divided into
equal steps, the step that holds the weighted quantile becomes the next range,
and so on until one key is left.  Every pass is one aggregation with map-side
combine over a narrow table; what comes back has one row per node.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertweft.llm.common import whole_row
from alertweft.session import materialise

#: a key is a coordinate of COORD bits followed by TIE bits of a hash, which order rows of equal coordinates
COORD, TIE = 20, 42
#: steps of one histogram
STEPS = 4096
#: a level of the tree is broadcast up to this many nodes; deeper nodes hold a small, even share of the rows each
NODES = 1 << 16
#: rows numbered by one task at a time
SLICE = 20_000


def category(column: str | Column) -> Column:
    """Coordinate of a categorical dimension: a hash of the value; null is 0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.shiftright(F.crc32(column.cast("string").cast("binary")), 32 - COORD), F.lit(0).cast("long"))


def magnitude(column: Column, bits: int = 40) -> Column:
    """Coordinate of a non-negative number, by its logarithm; null is 0."""
    scaled = F.floor(F.log2(column.cast("double") + 1) * ((1 << COORD) / bits))
    return F.coalesce(F.least(scaled, F.lit((1 << COORD) - 1)), F.lit(0).cast("long"))


class Metadata:
    """Columns that describe a document: id, size in bytes, checksum, and one key per dimension."""

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", dimensions: Iterable[Column] | None = None):
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.id = F.col(id_col)
        self.size = (F.octet_length(text) + 1).cast("long")
        self.crc = F.crc32(text.cast("binary"))
        coords = list(dimensions) if dimensions is not None else [category("source"), category("lang"), magnitude(F.octet_length(text))]
        tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col), self.crc), 64 - TIE)
        self.keys = [F.shiftleft(c, TIE) + tie for c in coords]

    def table(self, docs: DataFrame) -> DataFrame:
        return docs.select(
            self.id.alias("_id"), self.size.alias("_size"), self.crc.alias("_crc"), *[k.alias(f"_k{i}") for i, k in enumerate(self.keys)])

    def beside(self, docs: DataFrame, *without: str) -> DataFrame:
        """The documents, each row whole in ``_row``, with the metadata as further columns."""
        return docs.select(
            whole_row(docs, *without).alias("_row"), self.id.alias("_id"), self.size.alias("_size"), self.crc.alias("_crc"),
            *[k.alias(f"_k{i}") for i, k in enumerate(self.keys)])


def _key(dims: int) -> Column:
    return F.coalesce(*[F.when(F.col("_dim") == i, F.col(f"_k{i}")) for i in range(dims)])


def _side(nodes: DataFrame, level: int) -> DataFrame:
    """A level has at most 2^level nodes."""
    return F.broadcast(nodes) if 1 << level <= NODES else nodes


def place(rows: DataFrame, cuts: list[DataFrame], dims: int, shards: int) -> DataFrame:
    """``rows`` with their node: first shard ``_first`` and number of shards ``_count``."""
    # the root is a column and not a literal, so that the first join has a key like all others
    at = rows.withColumn("_first", (F.col("_size") * 0).cast("int")).withColumn("_count", F.lit(shards))
    for level, cut in enumerate(cuts):
        joined = at.join(_side(cut.select("_first", "_dim", "_cut", "_left"), level), "_first", "left")
        low, open_ = _key(dims) <= F.col("_cut"), F.col("_left").isNotNull()
        at = joined.select(
            *rows.columns,
            F.when(open_ & ~low, F.col("_first") + F.col("_left")).otherwise(F.col("_first")).alias("_first"),
            F.when(open_, F.when(low, F.col("_left")).otherwise(F.col("_count") - F.col("_left"))).otherwise(F.col("_count")).alias("_count"),
        )
    return at


def grow(meta: DataFrame, dims: int, shards: int) -> list[DataFrame]:
    """The cuts of every level: (_first, _dim, _cut, _left); rows with key <= _cut go to the first _left shards."""
    cuts: list[DataFrame] = []
    while 1 << len(cuts) < shards:
        level = len(cuts)
        rows = place(meta, cuts, dims, shards).where("_count > 1")
        wide = [F.shiftright(F.max(f"_k{i}"), TIE) - F.shiftright(F.min(f"_k{i}"), TIE) for i in range(dims)]
        nodes = rows.groupBy("_first", "_count").agg(
            F.sum("_size").alias("_bytes"), F.array(*wide).alias("_wide"),
            F.array(*[F.min(f"_k{i}") for i in range(dims)]).alias("_los"), F.array(*[F.max(f"_k{i}") for i in range(dims)]).alias("_his"))
        dim = F.array_position("_wide", F.array_max("_wide")).cast("int")
        left = F.floor(F.col("_count") / 2).cast("int")
        span = nodes.select(
            "_first", (dim - 1).alias("_dim"), left.alias("_left"), F.element_at("_los", dim).alias("_lo"), F.element_at("_his", dim).alias("_hi"),
            F.lit(0).cast("long").alias("_below"), F.lit(0).cast("long").alias("_weight"), (F.col("_bytes") * left / F.col("_count")).alias("_aim"))
        span = materialise(span, "kd-nodes")
        while True:
            key = _key(dims)
            step = F.floor((F.col("_hi") - F.col("_lo")) / STEPS) + 1
            inside = rows.select("_first", "_size", *[f"_k{i}" for i in range(dims)]).join(_side(span, level), "_first").where(
                (key >= F.col("_lo")) & (key <= F.col("_hi")))
            bars = inside.groupBy("_first", F.floor((key - F.col("_lo")) / step).alias("_step")).agg(
                F.sum("_size").alias("_weight"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
            run = W.partitionBy("_first").orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
            known = span.select("_first", "_dim", "_left", "_aim", F.col("_below").alias("_base"))
            held = bars.withColumn("_before", F.coalesce(F.sum("_weight").over(run), F.lit(0))).join(_side(known, level), "_first").withColumn(
                "_below", F.col("_base") + F.col("_before"))
            span = materialise(
                held.where("_below < _aim AND _below + _weight >= _aim").select(
                    "_first", "_dim", "_left", "_lo", "_hi", "_below", "_weight", "_aim"), "kd-nodes")
            if span.where("_lo < _hi").isEmpty():
                break
        # the key that holds the quantile goes to the side where it leaves the smaller error
        over = F.col("_below") + F.col("_weight") - F.col("_aim") <= F.col("_aim") - F.col("_below")
        cuts.append(span.select("_first", "_dim", "_left", F.when(over, F.col("_lo")).otherwise(F.col("_lo") - 1).alias("_cut")))
    return cuts


def numbered(rows: DataFrame, shard: str, slices: int, tie: list[Column], name: str) -> DataFrame:
    """``rows`` with gapless numbers from 0 per shard; each (shard, slice) is numbered by itself and moved by an offset."""
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*tie), F.lit(slices)))
    before = W.partitionBy(shard).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy(shard, "_slice").count().select(
        shard, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(shard, "_slice").orderBy(*tie)
    return cut.withColumn("_n", F.row_number().over(inside)).join(offsets, [shard, "_slice"]).select(
        *rows.columns, (F.col("_n") - 1 + F.col("_offset")).cast("long").alias(name))


def _slices(rows: int, shards: int) -> int:
    return max(1, -(-rows // (shards * SLICE)))


def shard_count(meta: DataFrame, target_bytes: int) -> int:
    """Leaves needed to bring a shard to ``target_bytes``."""
    return max(1, -(-(meta.agg(F.sum("_size")).first()[0] or 0) // target_bytes))


def assign(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id",
           text_col: str = "text", dimensions: Iterable[Column] | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    ``target_bytes`` sets the number of shards from the bytes of the corpus.
    Null metadata is the lowest coordinate and a null text has no bytes; every
    row has one byte more than its text.  Rows equal in id and text have one key
    and stay together; all other ties are split by hash.  Further columns are not
    read, and an empty table gives no rows.
    """
    described = Metadata(id_col, text_col, dimensions)
    meta = materialise(described.table(docs), "kd-meta")
    dims = len(described.keys)
    if target_bytes is not None:
        shards = shard_count(meta, target_bytes)
    placed = place(meta, grow(meta, dims, shards), dims, shards)
    rows = placed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_first").alias("shard"))
    return numbered(rows, "shard", _slices(meta.count(), shards), [F.col(id_col), F.col("text_crc32")], "slot")


def shard_documents(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text", dimensions: Iterable[Column] | None = None) -> DataFrame:
    """The documents with ``shard`` and ``slot``, gathered by shard; columns of these names are replaced, all others stay.

    Null and empty texts, ties, repeated rows and empty tables: see ``assign``.
    """
    described = Metadata(id_col, text_col, dimensions)
    meta = materialise(described.table(docs), "kd-meta")
    dims = len(described.keys)
    if target_bytes is not None:
        shards = shard_count(meta, target_bytes)
    cuts = grow(meta, dims, shards)
    placed = place(described.beside(docs, "shard", "slot"), cuts, dims, shards).withColumn("shard", F.col("_first"))
    found = numbered(placed, "shard", _slices(meta.count(), shards), [F.col("_id"), F.col("_crc")], "slot")
    return found.select("_row.*", "shard", "slot")
