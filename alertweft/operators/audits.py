"""Audits of cases, registers, exports and run inventories: constraint rows, never exceptions mid-job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.functions.text import labels


def provenance_errors() -> Column:
    """Contract of a provenance row: hash form, tier, at least one sensor, host present."""
    return labels([
        (~F.col("sha256").rlike("^[0-9a-f]{64}$"), "sha256"),
        (~F.col("tier").isin(1, 2), "tier"),
        (F.col("n_sensors") < 1, "sensors"),
        (F.length("primary_host") < 1, "primary_host"),
    ])


def report_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows present on one side only, or with differing fields; empty means comparable."""
    a = left.select(key, *fields).alias("a")
    b = right.select(key, *fields).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differs = [~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields]
    return both.filter(
        F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull() | reduce(lambda x, y: x | y, differs)
    ).select(
        F.col(f"a.{key}").isNull().alias("left_only"), F.col(f"b.{key}").isNull().alias("right_only"),
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        F.array_join(labels(list(zip(differs, fields))), "|").alias("mismatched"),
    )


def last_row_faults(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Export audit per file: only the last row carries the last-row flag, wrappers are canonical, keys are unique.

    The last row comes from an aggregated maximum, not from a window over the file.
    """
    last = rows.groupBy(*key).agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    copies = rows.groupBy(*key, "record_id").agg(F.count(F.lit(1)).alias("_copies"))
    joined = rows.join(last, key).join(copies, [*key, "record_id"])
    is_last = F.col(order) == F.col("_last")
    expected = F.when(is_last, F.array(F.lit("lastrow"), F.lit("preview"), F.lit("result"))).otherwise(F.array(F.lit("preview"), F.lit("result")))
    return joined.withColumn("errors", labels([
        (F.array_sort("wrapper_keys") != expected, "wrapper_keys"),
        (F.coalesce(F.col("preview"), F.lit(True)), "preview"),
        (is_last & ~F.coalesce(F.col("lastrow"), F.lit(False)), "lastrow"),
        (F.col("missing_fields") > 0, "required_fields"),
        (F.col("_copies") > 1, "duplicate"),
    ]))


def id_completeness(expected: DataFrame, actual: DataFrame, key: str | list[str]) -> DataFrame:
    """Ids that are missing, extra or duplicated in ``actual``; an id may have several columns."""
    key = [key] if isinstance(key, str) else key
    counted = actual.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    both = expected.select(*key).distinct().withColumn("_e", F.lit(True)).join(counted, key, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "duplicate")
    return both.select(*key, problem.alias("problem")).filter("problem is not null")



def contract_drift(runs: DataFrame, frozen: dict) -> DataFrame:
    """Fields of a run's requested configuration that differ from the frozen contract."""
    tests = [(~F.col(name).eqNullSafe(F.lit(value)), name) for name, value in frozen.items()]
    return runs.withColumn("drift", labels(tests)).filter(F.size("drift") > 0)


def structure_faults(listing: DataFrame, expected: list[str], forbidden: list[str]) -> DataFrame:
    """Per case: expected files that are absent and forbidden ones that are present."""
    present = listing.groupBy("case_id").agg(*[
        F.bool_or(F.col("file") == name).alias(f"p{i}") for i, name in enumerate(expected + forbidden)])
    faults = [(~F.col(f"p{i}"), f"MISSING {name}") for i, name in enumerate(expected)]
    faults += [(F.col(f"p{i + len(expected)}"), f"UNEXPECTED {name}") for i, name in enumerate(forbidden)]
    return present.select("case_id", labels(faults).alias("faults")).filter(F.size("faults") > 0)
