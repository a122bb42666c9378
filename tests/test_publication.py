"""Publication: what is audited is what readers get, and nothing is visible before its commit."""

import os

import pytest
from pyspark.sql import functions as F

from alertweft.session import scratch_path
from alertweft.sources import sinks


def changing(spark, flag, first, later):
    """A frame whose text is ``first`` when it is evaluated for the first time and ``later`` from then on."""

    def text(_):
        if os.path.exists(flag):
            return later
        open(flag, "w").close()
        return first

    return spark.range(1).coalesce(1).select(F.col("id"), F.udf(text, "string").asNondeterministic()("id").alias("text"))


def test_only_audited_rows_are_published(spark, tmp_path):
    path = scratch_path(spark, "neutral")
    out = sinks.publish(changing(spark, str(tmp_path / "a"), "clean", "a secret"), ["id", "text"], ["secret"], path)
    assert [tuple(r) for r in out.collect()] == [(0, "clean")] == [tuple(r) for r in sinks.published(spark, path).collect()]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.publish(spark.range(1), ["id"], [], path)
    assert [tuple(r) for r in sinks.published(spark, path).collect()] == [(0, "clean")]


@pytest.mark.parametrize("column", ["'a Secret'", "array('x', 'secret')", "map('k', 'a secret')", "map('secret', 'v')", "named_struct('a', array('secret'))"])
def test_a_leak_is_never_visible(spark, column):
    path = scratch_path(spark, "neutral")
    rows = spark.range(5).select("id", F.when(F.col("id") == 3, F.expr(column)).alias("a.b"), F.lit("secret").alias("private"))
    with pytest.raises(sinks.LeakError):
        sinks.publish(rows, ["id", "`a.b`"], ["secret"], path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.published(spark, path)
    assert sinks.publish(rows, ["id"], ["secret"], scratch_path(spark, "neutral")).columns == ["id"]


def test_empty_and_null_rows(spark):
    rows = spark.createDataFrame([(1, None)], "id long, text string")
    assert sinks.publish(rows, ["text"], ["secret"], scratch_path(spark, "neutral")).collect()[0].text is None
    assert sinks.publish(rows.limit(0), ["text"], ["secret"], scratch_path(spark, "neutral")).count() == 0


def test_frozen_copy_must_be_the_original(spark, tmp_path):
    good, bad = scratch_path(spark, "inputs"), scratch_path(spark, "inputs")
    status = sinks.freeze(spark.range(20).withColumn("text", F.lit("t")), "id", good)
    assert {r.status for r in status.collect()} == {"SAME"} and sinks.published(spark, good).count() == 20
    status = sinks.freeze(changing(spark, str(tmp_path / "b"), "one", "two"), "id", bad)
    assert "SAME" not in {r.status for r in status.collect()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.published(spark, bad)
