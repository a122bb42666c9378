"""The inventory's records meet in one shuffle by case, whatever keys they are matched by."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from alertweft.operators.integrity import digest_bytes, row_digest
from alertweft.operators.inventory import met, seen
from alertweft.plans.adapters import MODELS

CASES = [1, 2, 3, 8, 8, 11, 13, 16, 24, 24, 24, 40, 60, 104, None, None]


def folder(spark, tmp_path):
    orders = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame([(k, 1, "O", 1.0, None, "1") for k in CASES], orders).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def wanted():
    """Equal cases count as joins of equal keys do: outputs by outputs, and by continuity records where there are any."""
    rows = Counter()
    for k, n in Counter(k for k in CASES if k is not None).items():
        bound = k % 3 != 0 and k % 10 != 1
        status = ("api_time_byte_identity" if bound else "package_not_newer_than_output" if k % 4 else
                  "unresolved_package_newer_than_output" if k % 8 else "package_newer_but_byte_identity_documented")
        for model in MODELS:
            for r in (1, 2, 3):
                rows[k, model, r, "heldout" if k % 2 else "dev", k % 13 != 0, "api_time_bound" if bound else "reconstructed_after_run", status] += n ** (2 if k % 8 else 3)
    return rows


def test_summary_takes_one_shuffle_of_digests(spark, tmp_path):
    found = entry.queries()["agg_35"](spark, folder(spark, tmp_path))
    assert exchanges(found) <= 4  # outputs' keys, their usage, everything by case, the summary
    want = Counter()
    for (*_, used, binding, status), n in wanted().items():
        want[binding, status, "outputs"] += n
        want[binding, status, "with_usage"] += n * used
    assert {(r.binding_status, r.temporal_status, c): r[c] for r in found.collect() for c in ("outputs", "with_usage")} == want


def test_rows_take_one_shuffle_of_digests(spark, tmp_path):
    found = entry.queries()["jn_15"](spark, folder(spark, tmp_path))
    assert exchanges(found) <= 3  # outputs' keys, their usage, everything by case
    assert found.columns == ["case_id", "model", "round", "split", "has_usage", "binding_status", "temporal_status"]
    assert Counter(tuple(r) for r in found.collect()) == wanted()


def test_records_are_seen_by_several_keys(spark):
    outputs = spark.createDataFrame([(1, 1, "ab"), (1, 1, "cd"), (1, 2, "ab"), (2, 1, None)], "case_id long, round int, sha string")
    events = spark.createDataFrame([(1, 1, "ab"), (1, 1, "ab"), (1, 2, "cd"), (2, 2, "ab")], "case_id long, round int, sha string")
    notes = spark.createDataFrame([(1, "cd"), (3, "ab")], "case_id long, sha string")
    rows = met({"output": outputs, "event": events, "note": notes}, "case_id")
    found = rows.select("*", seen("event", "case_id", "round", "sha").alias("e"), seen("note", "case_id", "sha").alias("n")).filter("kind = 'output'")
    assert exchanges(found) == 1
    assert sorted((r.case_id, r.round, r.sha or "", r.e, r.n) for r in found.collect()) == [(1, 1, "ab", 2, 0), (1, 1, "cd", 0, 1), (1, 2, "ab", 0, 0), (2, 1, "", 0, 0)]


def test_digests_as_bytes(spark):
    row = spark.range(1).select(row_digest(F.col("id")).alias("hex"), digest_bytes(row_digest(F.col("id"))).alias("raw"), digest_bytes(F.lit("stale")).alias("none")).first()
    assert bytes(row.raw).hex() == row.hex and len(row.raw) == 32 and row.none is None
