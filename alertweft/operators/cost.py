"""Token cost: price lookup, canonical and incurred views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import FREE_TIER_MODELS, PRICES
from alertweft.session import merged


def price(model: Column, output: bool) -> Column:
    """List price per million tokens: first prefix in table order that fits, null when none does."""
    arms = [F.when(F.startswith(model, F.lit(prefix)), F.lit(out if output else inp)) for prefix, inp, out in PRICES]
    return F.coalesce(*arms)


def is_free(model: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(model, F.lit(m)) for m in FREE_TIER_MODELS])


def cost_aggregates() -> list[Column]:
    """Calls, tokens and costs; batch calls count half.  Token sums stay integers, prices multiply once per group."""
    half = F.when(F.col("billing_mode") == "batch", 1).otherwise(2)
    model = F.min("model")
    list_cost = (F.sum(F.col("input_tokens") * half) / F.lit(2e6) * price(model, False)
                 + F.sum(F.col("output_tokens") * half) / F.lit(2e6) * price(model, True))
    return [
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if(F.col("billing_mode") == "batch").cast("bigint").alias("batch_calls"),
        F.round(list_cost, 6).alias("list_cost"), F.when(is_free(model), F.lit(0.0)).otherwise(F.round(list_cost, 6)).alias("actual_cost"),
    ]


def latest_usage(usage: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last record per key; aggregated map-side, so repeated keys never pile up."""
    fields = [c for c in usage.columns if c not in keys]
    return usage.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_u")).select(*keys, "_u.*")


def canonical_usage(usage: DataFrame, outputs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest usage record of every current output; outputs without one have nulls."""
    return outputs.select(*keys).join(merged(latest_usage(usage, keys, order)), keys, "left")
