"""Search-export files: one loader for the shapes such exports come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_RESULT = "struct<_raw:string,raw:string,_time:string,EventRecordID:string,source:string>"
_RECORD = f"array<struct<_raw:string,raw:string,_time:string,EventRecordID:string,source:string,result:{_RESULT},results:array<{_RESULT}>>>"


def load_export(spark: SparkSession, path: str, pretty_printed: bool = False) -> DataFrame:
    """Rows of an export whose raw text is event XML or a stanza.

    Accepts one object per line, ``{"result": {...}}`` wrappers, a
    ``{"results": [...]}`` document and JSON arrays.  Line-based files stay
    splittable; only pretty-printed documents need ``pretty_printed``, which
    reads a whole file as one value.  Lines that are not JSON are skipped.
    """
    text = spark.read.text(path, wholetext=pretty_printed)
    records = text.select(F.explode(F.from_json("value", _RECORD)).alias("r"))
    plain = F.struct(*[F.col(f"r.{f}").alias(f) for f in ("_raw", "raw", "_time", "EventRecordID", "source")])
    items = F.coalesce(F.col("r.results"), F.when(F.col("r.result").isNotNull(), F.array("r.result")), F.array(plain))
    rows = records.select(F.explode(items).alias("result"))
    raw = F.coalesce(F.nullif("result._raw", F.lit("")), F.col("result.raw"))
    return rows.select("result", raw.alias("raw")).filter(F.contains("raw", F.lit("<Event")) | F.contains("raw", F.lit("EventCode=")))


def canonical_export(rows: DataFrame) -> DataFrame:
    """Four canonical fields of wrapped export rows; id and time come from the raw text when absent."""
    raw = F.col("result._raw")
    time = F.concat(F.regexp_extract(raw, r"SystemTime='([0-9T:\.\-]+)", 1), F.lit("Z"))
    return rows.select(
        F.coalesce(F.col("result._time"), time).alias("_time"),
        F.coalesce(F.col("result.EventRecordID"), F.regexp_extract(raw, r"<EventRecordID[^>]*>([^<]*)", 1)).alias("EventRecordID"),
        F.col("result.source").alias("source"), raw.alias("_raw"),
    )
