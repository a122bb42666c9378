"""Time correlation on a host without comparing pairs of events.

Events of a host are cut into time slices; each slice also receives the events
just outside its borders, as far as the window reaches.  The nearest earlier
and later partner of an event is then a running maximum or minimum inside one
(host, slice), so neither a hot host nor a dense minute multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _sliced(events: DataFrame, us: Column, window_us: int, slice_us: int) -> DataFrame:
    """Events with slice number; rows near a border also appear in the neighbour, marked as halo."""
    home = F.floor(us / slice_us)
    copies = F.array_compact(F.array(
        F.struct(home.alias("slice"), F.lit(False).alias("halo")),
        F.when(us - home * slice_us < window_us, F.struct((home - 1).alias("slice"), F.lit(True).alias("halo"))),
        F.when((home + 1) * slice_us - us <= window_us, F.struct((home + 1).alias("slice"), F.lit(True).alias("halo"))),
    ))
    return events.select("*", F.inline_outer(copies))


def nearest(events: DataFrame, host: str, us: str, groups: dict[str, Column], window_us: int,
            slice_us: int | None = None) -> DataFrame:
    """Add ``prev_<g>`` and ``next_<g>``: time of the nearest row of each group at or before / after the row.

    Distances beyond the window come out as null.
    """
    slice_us = max(slice_us or 3_600_000_000, 2 * window_us)
    cut = _sliced(events, F.col(us), window_us, slice_us)
    back = W.partitionBy(host, "slice").orderBy(F.col(us).asc())
    ahead = W.partitionBy(host, "slice").orderBy(F.col(us).desc())
    columns = []
    for name, test in groups.items():
        at = F.when(test, F.col(us))
        prev, nxt = F.max(at).over(back), F.min(at).over(ahead)
        columns += [F.when(F.col(us) - prev <= window_us, prev).alias(f"prev_{name}"), F.when(nxt - F.col(us) <= window_us, nxt).alias(f"next_{name}")]
    return cut.select("*", *columns).filter("not halo").drop("halo", "slice")


def corroborated(events: DataFrame, host: str, us: str, sensor: str, sensors: list[str], window_us: int) -> DataFrame:
    """Events with the number of distinct sensors that saw the host within the window."""
    found = nearest(events, host, us, {s: F.col(sensor) == s for s in sensors}, window_us)
    seen = sum((F.col(f"prev_{s}").isNotNull() | F.col(f"next_{s}").isNotNull()).cast("int") for s in sensors)
    return found.withColumn("n_sensors", seen)


def unconfirmed(events: DataFrame, host: str, us: str, precursor: Column, outcome: Column, window_us: int) -> DataFrame:
    """Precursors without the confirming outcome on the same host within the window after them."""
    found = nearest(events, host, us, {"outcome": outcome}, window_us)
    return found.filter(precursor & F.col("next_outcome").isNull())
