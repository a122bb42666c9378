"""Row numbers that do not put one hot key into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def split_row_number(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], name: str) -> DataFrame:
    """``row_number() over (partition by keys order by slice_by, order)`` in two parallel steps.

    Rows are numbered inside (keys, slice); slice sizes, a small table, give the
    offset of every slice.  ``slice_by`` must be a prefix of the wanted order.
    """
    tagged = df.withColumn("_part", slice_by)
    sizes = tagged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    numbered = tagged.withColumn("_rn", F.row_number().over(inside))
    # null-safe, so rows with a null key or slice keep their number
    named = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate([*keys, "_part"])], "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate([*keys, "_part"])])
    ranked = numbered.join(named, same).withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint"))
    return ranked.select(*df.columns, name)


def numbered_distinct(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct values per key with their 1-based rank; duplicates go before the rank window."""
    return df.select(*keys, value).distinct().withColumn(
        name, F.row_number().over(W.partitionBy(*keys).orderBy(value)).cast("bigint")
    )
