"""Scopes, searches, guards and deterministic selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.functions.text import str_array


def host_scope(prefix: str | None, host: str = "computer") -> Column:
    """Optional host-prefix filter: no prefix lets everything through."""
    return F.lit(True) if not prefix else F.startswith(F.col(host), F.lit(prefix))


def sensor_scope(pairs: list[tuple[str, str | None]], sensor: str = "sensor", host: str = "computer") -> Column:
    """True when one (sensor, host prefix) pair matches."""
    return reduce(lambda a, b: a | b, [(F.col(sensor) == s) & host_scope(p, host) for s, p in pairs])


def wildcard(value: Column, pattern: str) -> Column:
    """Case-insensitive search with ``*`` wildcards; all other characters are literal."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return value.ilike(escaped)


def all_fragments(text: Column, fragments: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(f)) for f in fragments], F.lit(True))


def not_exactly_one(records: DataFrame, selectors: dict[str, Column]) -> DataFrame:
    """Selectors that match no record or several, counted in one scan."""
    counts = records.agg(*[F.count_if(test).alias(f"c{i}") for i, test in enumerate(selectors.values())])
    rows = F.array(*[
        F.struct(F.lit(name).alias("selector"), F.col(f"c{i}").cast("bigint").alias("matches"))
        for i, name in enumerate(selectors)
    ])
    return counts.select(F.inline(rows)).filter("matches <> 1")


def first_in_order(records: DataFrame, keys: list[str], order: str, fields: list[str], latest: bool = False) -> DataFrame:
    """First (or last) record per key by ``order``; aggregated before the shuffle, so hot keys are cheap."""
    pick = F.max_by if latest else F.min_by
    return records.groupBy(*keys).agg(pick(F.struct(*fields), F.col(order)).alias("_first")).select(*keys, "_first.*")


def document_structure(docs: DataFrame, text: str, stale: list[str], sections: list[str]) -> DataFrame:
    """Documents with stale tokens or without a required section."""
    found = F.filter(str_array(stale), lambda t: F.contains(F.col(text), t))
    absent = F.filter(str_array(sections), lambda s: ~F.contains(F.col(text), s))
    checked = docs.withColumn("stale", F.array_join(found, "|")).withColumn("absent", F.array_join(absent, "|"))
    return checked.filter("stale <> '' or absent <> ''")
