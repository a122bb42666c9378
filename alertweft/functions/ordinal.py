"""Ordered enumerations: rank, band direction, signed distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from alertweft.fixed import CONDITION_POLICY
from alertweft.functions.text import str_array


def rank(value: Column, ordering: list[str]) -> Column:
    """Zero-based position in the ordering; null for an unknown value."""
    return (F.nullif(F.array_position(str_array(ordering), value), F.lit(0)) - 1).cast("int")


def _first_held(band: Column, ranked: list[tuple[int, str]]) -> Column:
    (at, value), *more = ranked
    chain = F.when(F.array_contains(band, value), at)
    for at, value in more:
        chain = chain.when(F.array_contains(band, value), at)
    return chain


def band_edges(band: Column, ordering: list[str]) -> tuple[Column, Column]:
    """Lowest and highest rank in a band, by membership tests: a lambda per value would leave generated code."""
    ranked = list(enumerate(ordering))
    return _first_held(band, ranked), _first_held(band, ranked[::-1])


def known_edges(band: Column, ordering: list[str]) -> Column:
    """Struct (low, high) of the band's edge ranks, null where it is empty or holds a value the ordering does not know.

    A pass over a band costs far more than a comparison of ranks, so frames hold this in a column.
    """
    low, high = band_edges(band, ordering)
    known = F.size(F.array_except(band, str_array(ordering))) == 0
    return F.when(known & (F.size(band) > 0), F.struct(low.alias("low"), high.alias("high")))


def ranked_direction(at: Column, edges: Column) -> Column:
    """:func:`direction` of a rank and the :func:`known_edges` of a band."""
    found = F.when(at > edges["high"], "over").when(at < edges["low"], "under").otherwise("in_band")
    return F.when(at.isNotNull() & edges.isNotNull(), found)


def ranked_distance(at: Column, edges: Column) -> Column:
    """:func:`signed_distance` of a rank and the :func:`known_edges` of a band."""
    low, high = edges["low"], edges["high"]
    found = F.when(at < low, at - low).when(at > high, at - high).otherwise(F.lit(0))
    return F.when(at.isNotNull() & edges.isNotNull(), found)


def direction(value: Column, band: Column, ordering: list[str]) -> Column:
    """``in_band``, ``over`` or ``under`` relative to the band; null if anything is unknown."""
    return ranked_direction(rank(value, ordering), known_edges(band, ordering))


def signed_distance(value: Column, band: Column, ordering: list[str]) -> Column:
    """Steps to the nearest band edge, negative below, zero inside; null if anything is unknown."""
    return ranked_distance(rank(value, ordering), known_edges(band, ordering))


def policy_value(condition: Column, part: int) -> Column:
    """One part of the condition policy (0 verdict, 1 severity, 2 actions, 3 roles) as a literal map lookup."""
    pairs = []
    for name, policy in CONDITION_POLICY.items():
        value = policy[part]
        pairs += [F.lit(name), F.lit(value) if isinstance(value, str) else str_array(value)]
    return F.create_map(*pairs)[condition]
