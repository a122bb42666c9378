"""Gap sessions and burst thresholds that stay parallel when one key is very large.

A window over one key alone would put a hot key into one task.  Sessions are
therefore built in two steps: inside (key, time slice) first, then only the
first and last local session of every slice are stitched along the key.  All
sessions strictly inside a slice are already final.  The stitch sees at most
two rows per (key, slice), however many events there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertweft.session import materialise


_FOREVER = 1 << 62


def _at_micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _local_sessions(events: DataFrame, keys: list[str], at: str, gap_us: int, slice_us: int,
                    order: Column) -> DataFrame:
    """Events with their time slice and a session number local to (keys, slice)."""
    sliced = events.withColumn("_us", _at_micros(F.col(at))).withColumn(
        "_slice", F.floor(F.col("_us") / slice_us)
    )
    w = W.partitionBy(*keys, "_slice").orderBy(F.col("_us"), order)
    new = F.coalesce(F.col("_us") - F.lag("_us").over(w) > gap_us, F.lit(True))
    return sliced.withColumn("_new", new.cast("int")).withColumn(
        "_local", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    )


def _chained(pieces: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Give every piece its session: (keys, _sub, _chain).

    Only the first and last piece of a slice can continue into a neighbouring
    slice; they share one window per key.  Every other piece is final and forms
    a window partition of its own, so one pass covers both kinds.
    """
    slice_w = W.partitionBy(*keys, "_slice")
    edge = (F.col("_local") == F.min("_local").over(slice_w)) | (F.col("_local") == F.max("_local").over(slice_w))
    marked = pieces.withColumn("_sub", F.when(~edge, F.struct("_slice", "_local")))
    along = W.partitionBy(*keys, "_sub").orderBy("start_us", "_slice", "_local")
    new = F.coalesce(F.col("start_us") - F.lag("end_us").over(along) > gap_us, F.lit(True)).cast("int")
    return marked.withColumn("_new", new).withColumn("_chain", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
            F.min_by("first", "_first_key").alias("first"), F.min("_first_key").alias("_first_key")]


def gap_sessions(events: DataFrame, keys: list[str], at: str, gap_seconds: float, order: Column,
                 first_fields: list[str], distinct: str | None = None,
                 slice_seconds: float = 86400.0) -> DataFrame:
    """One row per session: keys, n, start_us, end_us, the first event's fields, n_distinct.

    A new session starts when the gap to the previous event is greater than
    ``gap_seconds``.  ``order`` breaks ties between equal times.  Events are
    scanned and shuffled once; with ``distinct`` the per-value pieces are
    written once and read by the two steps that need them.
    """
    gap_us, slice_us = int(gap_seconds * 1_000_000), int(slice_seconds * 1_000_000)
    timed = events.filter(F.col(at).isNotNull())
    local = _local_sessions(timed, keys, at, gap_us, slice_us, order)
    part, session = [*keys, "_slice", "_local"], [*keys, "_sub", "_chain"]
    base = [
        F.count(F.lit(1)).alias("n"), F.min("_us").alias("start_us"), F.max("_us").alias("end_us"),
        F.min_by(F.struct(*first_fields), F.struct(F.col("_us"), order.alias("o"))).alias("first"),
        F.min(F.struct(F.col("_us").alias("us"), order.alias("o"))).alias("_first_key"),
    ]
    out = [*keys, "n", "start_us", "end_us", "first.*"]
    # an event without a time is infinitely far from every other one: a session of its own, of infinite length
    alone = events.filter(F.col(at).isNull()).select(
        *keys, F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("start_us"),
        F.lit(_FOREVER).alias("end_us"), *first_fields,
    )
    if distinct is None:
        chained = _chained(local.groupBy(*part).agg(*base), keys, gap_us)
        return chained.groupBy(*session).agg(*_merged()).select(*out).unionByName(alone)
    # per (piece, value): a hot session is spread over its values, and no set is ever gathered
    by_value = materialise(local.groupBy(*part, F.col(distinct).alias("_value")).agg(*base), "pieces")
    owner = _chained(by_value.groupBy(*part).agg(*_merged()), keys, gap_us).select(
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], "_sub", "_chain")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)])
    per_value = by_value.join(owner, same).groupBy(*session, "_value").agg(*_merged())
    sessions = per_value.groupBy(*session).agg(*_merged(), F.count(F.lit(1)).alias("n_distinct"))
    return sessions.select(*out, "n_distinct").unionByName(alone.withColumn("n_distinct", F.lit(1).cast("bigint")))


def plain_groups(events: DataFrame, keys: list[str], at: str, order: Column, first_fields: list[str],
                 distinct: str | None = None) -> DataFrame:
    """The same shape without a session gap: one group per key, partially aggregated before the shuffle."""
    timed = events.withColumn("_us", _at_micros(F.col(at)))
    sort = F.struct(F.when(F.col("_us").isNull(), 1).otherwise(0).alias("late"), F.col("_us"), order.alias("o"))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.min("_us").alias("start_us"), F.max("_us").alias("end_us"),
        F.count_if(F.col("_us").isNull()).alias("n_untimed"),
        F.min_by(F.struct(*first_fields), sort).alias("first"),
    ]
    if distinct:
        aggs.append((F.count_distinct(distinct) + F.max(F.col(distinct).isNull().cast("int"))).alias("n_distinct"))
    grouped = timed.groupBy(*keys).agg(*aggs)
    # an untimed member makes the time span infinite
    end = F.when(F.col("n_untimed") > 0, F.lit(_FOREVER)).otherwise(F.col("end_us"))
    start = F.when(F.col("n_untimed") > 0, F.lit(0)).otherwise(F.col("start_us"))
    columns = [*keys, "n", start.alias("start_us"), end.alias("end_us"), "first.*"]
    return grouped.select(*columns, *(["n_distinct"] if distinct else []))


def qualifying(sessions: DataFrame, count_gte: int, within_seconds: float | None = None,
               distinct_gte: int | None = None) -> DataFrame:
    """Sessions that meet the count, whole-session time span and distinct thresholds."""
    kept = sessions.filter(F.col("n") >= count_gte)
    if within_seconds is not None:
        kept = kept.filter(F.col("end_us") - F.col("start_us") <= int(within_seconds * 1_000_000))
    if distinct_gte is not None:
        kept = kept.filter(F.col("n_distinct") >= distinct_gte)
    return kept


def limits(rule: dict) -> dict:
    """Thresholds of a rule's aggregation block, times in microseconds."""
    block = rule["aggregation"]
    micros = lambda name: None if block.get(name) is None else int(block[name] * 1_000_000)
    distinct = block.get("distinct")
    return {"count": block["count_gte"], "gap": micros("session_gap_seconds_lte"), "within": micros("within_seconds_lte"),
            "distinct": distinct["count_gte"] if distinct else None}


def bursts(events: DataFrame, aggregation: dict, columns: dict[str, str], at: str, order: Column,
           first_fields: list[str]) -> DataFrame:
    """Qualifying groups of a rule's aggregation block; ``columns`` maps rule fields to columns."""
    keys = [columns[f] for f in aggregation["group_by"]]
    distinct = aggregation.get("distinct")
    field = columns[distinct["field"]] if distinct else None
    gap = aggregation.get("session_gap_seconds_lte")
    if gap is None:
        found = plain_groups(events, keys, at, order, first_fields, field)
    else:
        found = gap_sessions(events, keys, at, gap, order, first_fields, field)
    return qualifying(found, aggregation["count_gte"], aggregation.get("within_seconds_lte"),
                      distinct["count_gte"] if distinct else None)
