"""Matching several kinds of records in one shuffle.

Joins by different keys shuffle their rows again for every key, as a join takes no partitioning
by a part of its keys.  Windows do: rows of all kinds are dealt by what their keys have in common and
then count, inside it, the records of a kind that share their further keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertweft.session import spread


def met(kinds: dict[str, DataFrame], *common: str) -> DataFrame:
    """Rows of all kinds, marked in ``kind`` and dealt by the columns that all have; other columns are null where a kind has none."""
    marked = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    return spread(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked), *common)


def seen(kind: str, *keys: str) -> Column:
    """How many rows of a kind share the keys of a row.  Nulls are equal here: leave out rows whose keys must match and are null."""
    return F.count_if(F.col("kind") == kind).over(Window.partitionBy(*keys))
