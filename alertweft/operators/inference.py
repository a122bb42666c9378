"""Bootstrap intervals whose cost does not depend on the number of rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from alertweft.session import ship

_SLICE = 1000
ship(__name__)


def _draw(batches: Iterator[pd.DataFrame], seed: int, draws: int) -> Iterator[pd.DataFrame]:
    """Means of the draws of one slice, from the value histogram in each row."""
    for batch in batches:
        for label, values, counts, part in zip(batch["label"], batch["v"], batch["c"], batch["slice"]):
            counts, n = np.asarray(counts, dtype=np.int64), int(np.sum(counts))
            rng = np.random.default_rng([seed, zlib.crc32(label.encode()), int(part)])
            taken = rng.multinomial(n, counts / n, size=min(_SLICE, draws - int(part) * _SLICE))
            yield pd.DataFrame({"label": label, "mean": taken @ np.asarray(values) / n})


def bootstrap_mean_ci(values: DataFrame, keys: list[str], value: str, seed: int = 20260722, draws: int = 20000,
                      weight: str | None = None) -> DataFrame:
    """Percentile interval of the mean per key.

    Resampling n rows with replacement and averaging needs only how often each
    distinct value is drawn, which is multinomial over the value histogram.  So
    the rows are reduced to a histogram first; the draws of a key are split into
    slices that run as separate tasks, each seeded by (seed, key, slice).  The
    value is an ordinal distance or a pass difference, a handful of integers.
    ``weight`` counts a row several times, for rows that are counted already.
    """
    histogram = values.groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("c"))
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    packed = histogram.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), "c"))).alias("h"),
        F.sum("c").alias("n"),
    ).withColumn("label", label)
    slices = packed.select(
        "label", F.col("h.v").alias("v"), F.col("h.c").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // _SLICE))).alias("slice"),
    ).repartition("label", "slice")
    drawn = slices.mapInPandas(lambda batches: _draw(batches, seed, draws), "label string, mean double")
    ends = drawn.groupBy("label").agg(F.array_sort(F.collect_list("mean")).alias("m")).select(
        "label", F.bround(F.get("m", F.lit(int(0.025 * draws))), 4).alias("lower"),
        F.bround(F.get("m", F.lit(min(draws - 1, int(0.975 * draws)))), 4).alias("upper"))
    return packed.join(ends, "label").select(*keys, "n", "lower", "upper")
