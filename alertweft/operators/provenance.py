"""Declared source records against the sources: by line, by byte range, by CSV ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.sources.byte_ranges import csv_records, line_bytes, line_text, range_hashes


def csv_header(records: DataFrame) -> list[str]:
    """Column names of CSV files that share one header, without a byte order mark."""
    first = records.filter("ordinal = 1").select(line_text(F.col("raw")).alias("t")).first()
    if first is None:
        return []
    width = first.t.count(",") + 1
    cells = records.sparkSession.range(1).select(F.from_csv(F.lit(first.t.lstrip("﻿")), ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'}).alias("h"))
    return [c for c in cells.select("h.*").first() if c is not None]


def csv_fields(raw: Column, names: list[str]) -> Column:
    """Fields of one CSV record as a struct; missing ones at the end are empty."""
    cells = F.from_csv(line_text(raw), ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"', "maxCharsPerColumn": "-1"})
    return F.struct(*[F.coalesce(cells[f"c{i}"], F.lit("")).alias(n) for i, n in enumerate(names)])


def canonical_row(fields: Column, names: list[str]) -> Column:
    """A record as compact JSON with its names in order; control characters without a short escape get upper-case hex."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(names)]))


def verify_records(declared: DataFrame, lines: DataFrame, csv_lines: DataFrame, csv_id: str) -> DataFrame:
    """Rows of ``declared`` whose source record is absent or differs: its columns and ``problem``.

    ``declared`` has (kind, file, number, byte_start, byte_end, record_id, declared_sha256) and
    may have more.  Kind ``line`` finds the ``number``-th line and hashes it without
    its end; ``bytes`` hashes exactly ``[byte_start, byte_end)``, which must be a
    range inside the file that is not empty; ``csv`` finds the ``number``-th record,
    the header being the first, compares its ``csv_id`` column and hashes its
    canonical JSON.  ``lines`` and ``csv_lines`` are :func:`raw_lines` of the sources.
    Any other kind is a problem.  A record is named once per kind of fault.
    """
    of_kind = lambda kind: declared.filter(F.col("kind") == kind)
    differs = lambda actual: ~F.col("declared_sha256").eqNullSafe(actual)
    found = lambda problems: F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in problems]))
    columns = declared.columns

    by_line = lines.select("file", F.col("line_no").alias("number"), F.sha2(line_bytes(F.col("raw")), 256).alias("_actual"))
    line = of_kind("line").join(by_line, ["file", "number"], "left").withColumn("_p", found([
        (F.col("_actual").isNull(), "absent"), (F.col("_actual").isNotNull() & differs(F.col("_actual")), "mismatch")]))

    ranges = range_hashes(of_kind("bytes").select("file", "byte_start", "byte_end", F.struct(*columns).alias("_row")))
    sound = F.coalesce(F.col("sha256").isNotNull() & (F.col("byte_start") < F.col("byte_end")), F.lit(False))
    byte = ranges.withColumn("_p", found([(~sound, "invalid byte range"), (sound & ~F.col("_row.declared_sha256").eqNullSafe(F.col("sha256")), "mismatch")])).select("_row.*", "_p")

    records = csv_records(csv_lines)
    names = csv_header(records)
    if names:
        rows = records.filter("ordinal > 1").select("file", F.col("ordinal").alias("number"), csv_fields(F.col("raw"), names).alias("_f"))
        actual = rows.select("file", "number", (F.col("_f")[csv_id] if csv_id in names else F.lit("")).alias("_id"), F.sha2(canonical_row(F.col("_f"), names), 256).alias("_actual"))
    else:
        actual = records.select("file", F.col("ordinal").alias("number"), F.lit("").alias("_id"), F.lit("").alias("_actual"))
    here = F.col("_actual").isNotNull()
    csv = of_kind("csv").join(actual, ["file", "number"], "left").withColumn("_p", found([
        (~here, "absent"), (here & ~F.col("record_id").eqNullSafe(F.col("_id")), "id mismatch"), (here & differs(F.col("_actual")), "mismatch")]))

    other = declared.filter(F.coalesce(~F.col("kind").isin("line", "bytes", "csv"), F.lit(True))).withColumn("_p", F.array(F.lit("unknown locator")))
    parts = [part.select(*columns, F.explode("_p").alias("problem")) for part in (line, byte, csv, other)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
