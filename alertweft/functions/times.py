"""Timestamp parsing and sort keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted layouts, most frequent first.
LAYOUTS = ["MM/dd/yyyy hh:mm:ss a", "MMM d, yyyy @ HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss[.S]"]


def parse_time(text: Column) -> Column:
    """Instant of any accepted layout, null when none fits.

    ISO text with zero to nine fractional digits is cast directly (Spark keeps
    microseconds); audit records carry their epoch as ``audit(<seconds>:``.
    """
    epoch = F.regexp_extract(text, r"audit\((\d+(?:\.\d+)?):", 1)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(
        iso,
        *[F.try_to_timestamp(text, F.lit(layout)) for layout in LAYOUTS],
        F.when(epoch != "", F.timestamp_micros((epoch.try_cast("decimal(20,6)") * 1000000).cast("bigint"))),
    )


def with_z(text: Column) -> Column:
    """Append the UTC marker when it is missing."""
    return F.when(text.endswith("Z"), text).otherwise(F.concat(text, F.lit("Z")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def natural_key(text: Column) -> Column:
    """Sort key that orders embedded numbers by value, other text by lower case."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def piece_key(p):
        # a number sorts by its digit count, then by its digits
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(p.rlike(r"^\d"), number).otherwise(F.concat(F.lit("1"), F.lower(p)))

    return F.transform(pieces, piece_key)


def event_order(time_text: Column, parsed: Column, record_key: Column) -> Column:
    """Order of events: parseable instants first, then raw text, ties by natural record key."""
    return F.struct(
        F.when(parsed.isNull(), F.lit(1)).otherwise(F.lit(0)).alias("late"),
        F.coalesce(F.unix_micros(parsed), F.lit(0)).alias("at"),
        F.when(parsed.isNull(), F.coalesce(time_text, F.lit(""))).otherwise(F.lit("")).alias("text"),
        natural_key(record_key).alias("key"),
    )
