"""Saved decisions: discovery by path and run-tag decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Run tag layout ``model__arm[_roundN]`` and tags that are not study runs.
TAG = r"^(.+?)__(A\d.*?)(?:_round(\d+))?$"
SKIPPED_TAGS = r"__EXP_|(?i:void)"


def base_model(tag: Column) -> Column:
    """Model part of a tag."""
    return F.split_part(F.split_part(tag, F.lit("__"), F.lit(1)), F.lit("_round"), F.lit(1))


def round_of(tag: Column) -> Column:
    """Round number of a tag, 1 when it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(tag, r"_round(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def build_tag(model: Column, arm: Column, round_no: Column) -> Column:
    """Tag text; characters that are unsafe in a path become ``-``."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-")
    return F.concat(safe(model), F.lit("__"), safe(arm), F.when(round_no > 1, F.concat(F.lit("_round"), round_no.cast("string"))).otherwise(""))


def decode_tag(tag: Column) -> list[Column]:
    return [F.regexp_extract(tag, TAG, 1).alias("model"), F.regexp_extract(tag, TAG, 2).alias("arm"), round_of(tag).alias("round")]


def read_outputs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Decision files below ``<path>/tag=<tag>/split=<split>/``, tags decoded, skipped tags left out."""
    rows = spark.read.schema(schema).json(path, pathGlobFilter="*.json", recursiveFileLookup=True)
    where = F.col("_metadata.file_path")
    placed = rows.select("*", F.url_decode(F.regexp_extract(where, r"/(?:tag=)?([^/]+)/(?:split=)?[^/]+/[^/]+$", 1)).alias("tag"),
                         F.regexp_extract(where, r"/(?:split=)?([^/]+)/[^/]+$", 1).alias("split"))
    return placed.filter(~F.col("tag").rlike(SKIPPED_TAGS)).select("*", *decode_tag(F.col("tag")))
