"""Rules, gate and usage log on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from alertweft.fixed import RUNTIME_POLICY
from alertweft.operators.gate import decide, routed
from alertweft.operators.rules import match_rules
from alertweft.operators.scoring import unknown_citations, with_cited_ids
from alertweft.session import scratch_path


def file_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str) -> DataFrame:
    """Stream of parquet files with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def alerts(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Stateless rule matches of arriving events."""
    return match_rules(events, rules)


def burst_sessions(events: DataFrame, keys: list[str], at: str, gap_seconds: float, distinct: str,
                   count_gte: int, distinct_gte: int, late: str = "10 minutes") -> DataFrame:
    """Closed gap sessions that meet the thresholds.

    State per open session is a counter, two times and the set of its distinct
    values, so a threshold on them is exact; repeated values take no room.
    """
    us = F.unix_micros(at)
    sessions = events.withWatermark(at, late).groupBy(*keys, F.session_window(at, f"{gap_seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.size(F.collect_set(distinct)).cast("bigint").alias("n_distinct"))
    return sessions.filter((F.col("n") >= count_gte) & (F.col("n_distinct") >= distinct_gte)).drop("w")


def gate_stream(decisions: DataFrame, facts: DataFrame, ids: DataFrame, path: str, policy: dict = RUNTIME_POLICY) -> StreamingQuery:
    """Route arriving decisions against static package tables, one file set per micro-batch.

    ``facts`` has one row per package, ``ids`` one row per (case, evidence id).
    Each micro-batch runs the batch joins, so no state is kept and a package
    with very many ids is never gathered.  A replayed batch overwrites itself.
    """

    def route_batch(batch: DataFrame, epoch: int) -> None:
        cited = with_cited_ids(batch, upper_keys=True)
        unknown = unknown_citations(cited, ids, ["case_id"])
        inputs = cited.join(facts, "case_id").join(unknown, "case_id", "left").withColumn(
            "unknown_ids", F.coalesce("unknown_ids", F.array().cast("array<string>")))
        routed(decide(inputs, policy)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return decisions.writeStream.foreachBatch(route_batch).trigger(availableNow=True).option("checkpointLocation", f"{path}-state").start()


def upsert_latest(usage: DataFrame, path: str, keys: list[str], order: Column, buckets: int = 16) -> StreamingQuery:
    """Keep the latest record of every key in a table of one row per key, see :func:`latest`.

    Each micro-batch is reduced to one record per key.  A key lives in a bucket by its hash.  The
    first version of a bucket is full; later batches add versions that hold their own keys only, and
    when these have as many rows as the full version, the bucket is written anew as one.  So a
    row is written a bounded number of times, however many batches come, and a bucket holds at
    most twice its keys.  No state is kept besides the table.  One small file of commits a batch says which
    versions hold which buckets, so readers never see half a batch, and a batch that is run again
    starts from the versions before it and replaces its own.  Records of equal order are settled by
    their other fields.  ``buckets`` should follow the size of the table.
    """
    fields = [c for c in usage.columns if c not in keys]
    numbered = usage.withColumn("_order", order)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    # a first, empty commit, so that there is always something to read
    usage.sparkSession.createDataFrame([], _COMMIT).write.mode("ignore").parquet(f"{path}/commits/version=-1")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        changed = _newest(batch, keys, fields).persist()
        try:
            sizes = {r.bucket: r.n for r in changed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()}  # no more than there are buckets
            if not sizes:
                return
            live = _live(spark, path, epoch)
            grown = {b: sum(v.n or 0 for v in live.get(b, [])[1:]) + n for b, n in sizes.items()}
            full = [b for b in sizes if not live.get(b) or grown[b] >= (live[b][0].n or 0)]
            new = changed.select("*", bucket)
            places = [_place(path, v) for b in full for v in live.get(b, [])]
            if places:
                old = spark.read.schema(changed.schema).parquet(*places)
                again = _newest(old.unionByName(new.filter(F.col("bucket").isin(full)).drop("bucket")), keys, fields).select("*", bucket)
                new = new.filter(~F.col("bucket").isin(full)).unionByName(again)
            new.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/version={epoch}")
            rows = [(b, b in full, grown[b] + (live[b][0].n or 0 if live.get(b) else 0) if b in full else n, keys) for b, n in sizes.items()]
            spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={epoch}")
        finally:
            changed.unpersist()

    return numbered.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", f"{path}-state").start()


#: a commit's row of a bucket: whether its version is full, the most rows it can have, the keys of the table
_COMMIT = "bucket int, full boolean, n bigint, keys array<string>"


def _newest(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The record of highest order of each key, with that ``_order``."""
    top = F.max(F.struct("_order", F.struct(*fields).alias("record"))).alias("u")
    return rows.groupBy(*keys).agg(top).select(*keys, "u.record.*", "u._order")


def _live(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list]:
    """Commit rows of each bucket from its newest full version on, oldest first; of versions before a batch if one is given."""
    commits = spark.read.schema(f"{_COMMIT}, version bigint").parquet(f"{path}/commits")
    found: dict[int, list] = {}
    for row in sorted(commits.collect(), key=lambda r: r.version):  # versions times buckets
        if before is not None and row.version >= before:
            continue
        found[row.bucket] = [row] if row.full is not False else [*found.get(row.bucket, []), row]
    return found


def _place(path: str, row) -> str:
    return f"{path}/data/version={row.version}/bucket={row.bucket}"


def _places(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """Folder of the newest full version of each bucket, of those before a batch if one is given."""
    return {b: _place(path, rows[0]) for b, rows in _live(spark, path, before).items()}


def latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table of :func:`upsert_latest`, with the columns of ``like``: one row per key."""
    live = _live(spark, path)
    if not live:
        return spark.createDataFrame([], like.schema)
    whole = [_place(path, rows[0]) for rows in live.values() if len(rows) == 1]
    parts = [_place(path, row) for rows in live.values() if len(rows) > 1 for row in rows]
    tables = [spark.read.schema(like.schema).parquet(*whole)] if whole else []
    if parts:
        keys = next(rows[-1]["keys"] for rows in live.values() if len(rows) > 1)
        fields = [c for c in like.columns if c not in keys]
        # the type of the order is the files' own
        kept = spark.read.parquet(*parts)
        tables.append(_newest(kept, keys, fields).select(*like.columns))
    return reduce(DataFrame.unionByName, tables)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available, append to a table in the shared folder, return the table."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
