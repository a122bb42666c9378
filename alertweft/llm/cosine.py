"""Embedding near-duplicates: PCA-ordered tiles with suffix-norm bounds.

Vectors are scaled to length one and rotated onto the principal axes of the
whole table, strongest first.  Two unit vectors with a cosine of t are at most
sqrt(2 - 2t) apart on every axis, so vectors are dealt to cells along the first
axis and only cells within reach meet.  Cells are cut into tiles of bounded size.
For two tiles the leading axes are multiplied first; what the remaining axes can
still add is at most the product of the suffix norms, and pairs that cannot
reach the threshold any more are left.  Survivors are decided by the cosine of
the unrotated vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from alertweft.llm.common import components
from alertweft.session import materialise, ship

ship(__name__)

TILE = 1024
#: axes multiplied between two looks at the bound
AXES = 8
#: slack of the bound, far above the rounding of sums over unit vectors
SLACK = 1e-9
#: vector lengths that get axes of their own; vectors of further lengths keep their own axes
LENGTHS = 64


def usable(vector: str):
    """True for vectors that can have a cosine: no null, NaN or infinite component, not all zero."""
    x = F.col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & good & F.exists(x, lambda v: v != 0)


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from the second moments of all unit vectors.

    Every task adds its rows up to one matrix per length; the sums, whose size is
    the square of the length and does not depend on the rows, reach the driver.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                unit = _unit(_matrix(batch.column(0).filter(pa.array(sizes == d)), d))
                sums[d] = sums.get(d, 0) + unit.T @ unit
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["d", "m"])

    def add(group: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(m, np.float64) for m in group.column("m").to_pylist())
        return pa.table({"d": group.column("d").slice(0, 1), "m": pa.array([whole.tobytes()], pa.binary())})

    parts = vectors.select("vector").mapInArrow(moments, "d int, m binary")
    rows = parts.groupBy("d").applyInArrow(add, "d int, m binary").orderBy("d").limit(LENGTHS).collect()
    return {r.d: np.ascontiguousarray(np.linalg.eigh(np.frombuffer(r.m, np.float64).reshape(r.d, r.d))[1][:, ::-1]) for r in rows}


def _rotate(raw: np.ndarray, turn: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unit = _unit(raw)
    return unit, unit @ turn[unit.shape[1]] if unit.shape[1] in turn else unit


def near_pairs(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows with cosine >= threshold; a and b are (unit, rotated)."""
    (ua, ra), (ub, rb) = a, b
    found = np.zeros((len(ua), len(ub)), dtype=bool)
    # norms of what is left from each axis on
    sa, sb = (np.sqrt(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]) for r in (ra, rb))
    rows, cols, total = np.arange(len(ua)), np.arange(len(ub)), 0.0
    for at in range(0, ra.shape[1], AXES):
        total = total + ra[rows, at : at + AXES] @ rb[cols, at : at + AXES].T
        end = at + AXES
        if end < ra.shape[1]:
            alive = total + np.outer(sa[rows, end], sb[cols, end]) >= threshold - SLACK
        else:
            alive = total >= threshold - SLACK
        keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
        if not keep_r.any():
            return found
        rows, cols, total, alive = rows[keep_r], cols[keep_c], total[np.ix_(keep_r, keep_c)], alive[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(alive)
    exact = np.abs(total[i, j] - threshold) <= 1e-6
    ok = total[i, j] >= threshold
    ok[exact] = np.einsum("ij,ij->i", ua[rows[i[exact]]], ub[cols[j[exact]]]) >= threshold
    found[rows[i[ok]], cols[j[ok]]] = True
    return found


def _classes(linked: np.ndarray) -> np.ndarray:
    """Smallest member reachable, for a symmetric boolean matrix with a true diagonal."""
    n, mine = len(linked), np.arange(len(linked))
    while True:
        seen = np.where(linked, mine[None, :], n).min(axis=1)
        seen = seen[seen]
        if (seen == mine).all():
            return mine
        mine = seen


def links(vectors: DataFrame, threshold: float, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(counts, spanning links) of the distinct vectors (key, label, vector, weight).

    counts: (key, n_links), the summed weight of other vectors linked directly.
    """
    turn = axes(vectors)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    width = reach / 2
    spread = vectors.sparkSession.sparkContext.broadcast({d: np.ascontiguousarray(t[:, 0]) for d, t in turn.items()})

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = spread.value
        for batch in batches:
            vector = batch.column(batch.schema.get_field_index("vector"))
            sizes = vector.value_lengths().to_numpy()
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                unit = _unit(_matrix(vector.take(pa.array(at)), d))
                cell[at] = np.floor((unit @ first[d] if d in first else unit[:, 0]) / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    sized = vectors.select("key", "label", "weight", "vector", F.size("vector").alias("d"))
    schema = T.StructType([*sized.schema.fields, T.StructField("cell", T.IntegerType())])
    cells = materialise(sized.mapInArrow(to_cells, schema), "cosine-cells")
    place = ["label", "d", "cell"]
    parts = cells.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    tiles = parts.select(*place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # every tile meets itself and the tiles behind it, in its own cell and in those within reach
    ahead = tiles.select("label", "d", "cell", "part", F.explode(F.sequence(F.col("cell"), F.col("cell") + 2)).alias("to_cell"))
    right = tiles.select("label", "d", F.col("cell").alias("to_cell"), F.col("part").alias("to_part"))
    pairs = ahead.join(right, ["label", "d", "to_cell"]).where("to_cell > cell OR to_part >= part").select(
        "label", "d", F.struct("cell", "part").alias("a"), F.struct(F.col("to_cell").alias("cell"), F.col("to_part").alias("part")).alias("b")
    )
    pairs = pairs.withColumn("pair", F.xxhash64("label", "d", "a", "b"))
    sides = pairs.select("label", "d", F.explode(F.array(
        F.struct("a.cell", "a.part", "pair", F.lit(0).alias("side")), F.struct("b.cell", "b.part", "pair", F.lit(1).alias("side"))
    )).alias("s")).select("label", "d", "s.*")
    member = cells.join(parts, place).withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int"))
    rows = member.join(sides, [*place, "part"]).select("label", "d", "pair", "side", "key", "weight", "vector")

    def compare(group: pa.Table) -> pa.Table:
        side, key = group.column("side").to_numpy(), group.column("key").to_numpy()
        weight, d = group.column("weight").to_numpy(), group.column("d")[0].as_py()
        unit, turned = _rotate(_matrix(group.column("vector"), d), {d: rotation.value[d]} if d in rotation.value else {})
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        same = len(left) == len(right) and np.array_equal(np.sort(key[left]), np.sort(key[right]))
        if same:
            right = left
        hit = near_pairs((unit[left], turned[left]), (unit[right], turned[right]), threshold)
        if same:
            hit |= hit.T
            np.fill_diagonal(hit, False)
            keys, counts = key[left], hit @ weight[left]
            whole = hit
        else:
            keys = np.concatenate([key[left], key[right]])
            counts = np.concatenate([hit @ weight[right], hit.T @ weight[left]])
            n = len(left)
            whole = np.zeros((len(keys), len(keys)), dtype=bool)
            whole[:n, n:], whole[n:, :n] = hit, hit.T
        some = np.flatnonzero(counts)
        if len(some):
            part = whole[np.ix_(some, some)]
            np.fill_diagonal(part, True)
            root = keys[some][_classes(part)]
        else:
            root = keys[:0]
        return pa.table({"key": keys[some], "n_links": counts[some].astype(np.int64), "root": root})

    rotation = vectors.sparkSession.sparkContext.broadcast(turn)
    compared = rows.groupBy("label", "d", "pair").applyInArrow(compare, "key long, n_links long, root long")
    compared = materialise(compared, "cosine-pairs")
    return compared.groupBy("key").agg(F.sum("n_links").alias("n_links")), compared.where("key <> root").select(
        F.col("key").alias("a"), F.col("root").alias("b"))


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.93, tile: int = TILE,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and the cosine is at least
    ``threshold``.  Rows with a null label and vectors that are null, empty, zero,
    or hold a null or non-finite component link with nothing and stand alone;
    vectors of different lengths never link.  Equal vectors under a label are
    compared once, with their number.  Repeated ids count as rows of their own; a
    row with a null id takes part but names no component.  Other columns are not read.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    fit = usable("vector") & F.col("label").isNotNull()
    # -0.0 and 0.0 are one value
    plain = rows.withColumn("vector", F.when(fit, F.transform("vector", lambda v: v.cast("double") + F.lit(0.0)))).withColumn(
        "key", F.when(fit, F.xxhash64("label", "vector")))
    unique = plain.where("key IS NOT NULL").groupBy("label", "vector").agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"))
    unique = unique.withColumn("key", F.xxhash64("label", "vector"))
    unique = materialise(unique, "cosine-vectors")
    counts, spans = links(unique, threshold, tile)
    labels = components(spans, "cosine-links").withColumnsRenamed({"node": "key"})
    rooted = unique.select("key", "weight", "first").join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = rooted.join(named, "root").join(counts, "key", "left").select(
        "key", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = plain.select("id", "key").join(answer, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
