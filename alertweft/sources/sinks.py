"""Sinks: documents, reports, append-only logs, incremental and two-tier publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertweft.operators.integrity import reconcile, row_digest
from alertweft.operators.redaction import has_any
from alertweft.session import materialise


class LeakError(RuntimeError):
    """A publication that would expose research-side text."""


def write_documents(documents: DataFrame, path: str, partition: str | None = None) -> None:
    """One JSON document per case, in gzip files: documents repeat their field names, and are read as a whole."""
    writer = documents.write.mode("errorifexists").option("compression", "gzip")
    (writer.partitionBy(partition) if partition else writer).json(path)


def report_columns(df: DataFrame) -> DataFrame:
    """List columns become pipe-joined text."""
    return df.select(*[
        F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields
    ])


def write_report(df: DataFrame, path: str) -> None:
    """CSV report with a header."""
    report_columns(df).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    rows.write.mode("append").json(path)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items without an output yet."""
    return work.join(done.select(key), key, "left_anti")


def _leaking(staged: DataFrame, forbidden: list[str]) -> DataFrame:
    """Rows with a forbidden pattern in any text, also inside arrays, maps and structs."""
    hit = F.lit(False)
    for field in staged.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("array", "map", "struct", "variant"):
            hit = hit | F.coalesce(has_any(F.to_json(F.col(f"`{field.name}`")), forbidden), F.lit(False))
        elif kind in ("string", "varchar", "char"):
            hit = hit | F.coalesce(has_any(F.col(f"`{field.name}`"), forbidden), F.lit(False))
    return staged.filter(hit)


def _stage(rows: DataFrame, path: str) -> tuple[str, DataFrame]:
    """Write ``rows`` once below ``path``, where no reader looks yet; (folder, what was written)."""
    folder = f"{path}/staged/{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(folder)
    return folder, rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _commit(spark: SparkSession, path: str, folder: str) -> None:
    """One row that names the published folder; it is written last, in one file, and only once."""
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/published")


def published(spark: SparkSession, path: str) -> DataFrame:
    """What ``publish`` or ``freeze`` committed; an error where nothing was."""
    return spark.read.parquet(spark.read.schema("folder string").parquet(f"{path}/published").first().folder)


def publish(rows: DataFrame, allowed: list[str], forbidden: list[str], path: str) -> DataFrame:
    """Write the allowed columns only; refuse when any text in them matches a forbidden pattern.

    The rows are evaluated once, into staged files.  What was written is audited, and a
    commit marker then makes it visible, so a frame that would change from one
    run to the next cannot publish what was not looked at.
    """
    folder, staged = _stage(rows.select(*allowed), path)
    if not _leaking(staged, forbidden).isEmpty():
        raise LeakError("a published column matches a forbidden pattern")
    _commit(rows.sparkSession, path, folder)
    return published(rows.sparkSession, path)


def freeze(rows: DataFrame, key: str, path: str) -> DataFrame:
    """A copy of ``rows`` that is published only where every row of it is the original's, by key and digest.

    Returns (key, status) of :func:`reconcile`; nothing is committed unless all are SAME.
    A new copy stands beside earlier ones, so no stale row can stay in it.
    """
    digest = lambda df: df.select(key, row_digest(*[F.col(f"`{c}`") for c in rows.columns]).alias("sha256"))
    folder, staged = _stage(rows, path)
    status = materialise(reconcile(digest(rows), digest(staged), key, "sha256"), "freeze")
    if status.filter("status <> 'SAME'").isEmpty():
        _commit(rows.sparkSession, path, folder)
    return status
