"""The usage table holds one row per key after any batches, in any order, run once or twice."""

import random
from itertools import count

from pyspark.sql import functions as F

from alertweft.session import scratch_path
from alertweft.streaming import rules as Z

COLUMNS = "case_id long, model string, seq int, tokens long"


def ingest(spark, rows, source, target):
    df = spark.createDataFrame(rows, COLUMNS)
    df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    Z.upsert_latest(stream, target, ["case_id", "model"], F.col("seq"), buckets=4).awaitTermination()
    return df


def held(spark, target, like):
    return sorted(map(tuple, Z.latest(spark, target, like).collect()), key=repr)


def test_last_record_per_key(spark):
    rng, number = random.Random(9), count()
    source, target = scratch_path(spark, "usage-in"), scratch_path(spark, "usage")
    want = {}
    for _ in range(4):
        rows = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice("ab"), rng.randrange(50), next(number)) for _ in range(rng.choice([1, 12]))]
        like = ingest(spark, rows, source, target)
        for r in rows:
            want[r[:2]] = max(want.get(r[:2], r), r, key=lambda x: x[2:])
        assert held(spark, target, like) == sorted(want.values(), key=repr)


def test_a_batch_that_is_run_again(spark):
    """A commit without the batch's end, and data without a commit: both are replaced by the next run of that batch."""
    source, target = scratch_path(spark, "usage-in"), scratch_path(spark, "usage")
    like = ingest(spark, [(1, "a", 1, 10), (2, "a", 1, 20), (3, "a", 1, 30)], source, target)
    half = spark.createDataFrame([(1, "a", 9, 99, b) for b in range(4)], COLUMNS + ", bucket int")
    half.write.partitionBy("bucket").parquet(f"{target}/data/version=1")
    assert held(spark, target, like) == [(1, "a", 1, 10), (2, "a", 1, 20), (3, "a", 1, 30)]
    spark.createDataFrame([(b,) for b in range(4)], "bucket int").write.parquet(f"{target}/commits/version=1")
    assert (1, "a", 9, 99) in held(spark, target, like)
    assert all("version=0" in place for place in Z._places(spark, target, before=1).values())
    ingest(spark, [(1, "a", 2, 11), (2, "a", 0, 0), (3, "a", 3, 31), (4, "a", 1, 40)], source, target)
    rows = held(spark, target, like)
    touched = {(1, "a", 2, 11), (2, "a", 1, 20), (3, "a", 3, 31), (4, "a", 1, 40)}
    assert touched <= set(rows)


def test_nothing_arrived(spark):
    target = scratch_path(spark, "usage")
    like = ingest(spark, [], scratch_path(spark, "usage-in"), target)
    assert held(spark, target, like) == []


def test_small_batches_leave_the_table_unwritten(spark):
    """Batches that touch every bucket add their own rows; a bucket is written anew only when these are as many as it holds."""
    source, target = scratch_path(spark, "usage-in"), scratch_path(spark, "usage")
    base = [(k, "a", 1, k) for k in range(200)]
    ingest(spark, base, source, target)
    for turn in range(2, 5):
        like = ingest(spark, [(k, "a", turn, k) for k in range(20)], source, target)
    assert held(spark, target, like) == sorted([(k, "a", 4, k) if k < 20 else (k, "a", 1, k) for k in range(200)], key=repr)
    assert spark.read.parquet(f"{target}/data").count() == 260
