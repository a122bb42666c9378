"""Manifests and snapshot comparison over a data lake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertweft.sources.byte_ranges import listed, located, range_hashes

# Manifest categories, first matching prefix wins.
CATEGORIES = [
    ("archive", ["archive/"]), ("experiments", ["experiments/"]), ("dataset", ["tier1/", "tier2/"]), ("spec", ["rubric/", "tools/schema/"]),
    ("outputs", ["eval/outputs/"]), ("harness", ["eval/", "tools/"]),
]


def row_digest(*parts: Column) -> Column:
    """Identity of a row: hash of its parts in the given order."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def digest_bytes(digest: Column) -> Column:
    """A digest of ``row_digest`` as its bytes, half as many to shuffle; null for a text that is no hex number."""
    return F.unhex(digest)


def category(path: Column) -> Column:
    chain = None
    for name, prefixes in CATEGORIES:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | F.startswith(path, F.lit(prefix))
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise("docs")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256, category of every file below ``root``.

    Files are listed by name, largest first dealt to the tasks; a task reads and hashes
    a file in steps, so a file of any size takes the same memory.  A digest of one file
    is one task's work.  Files named with a leading ``_`` or ``.`` are left out.
    """
    top = located(root)[1].rstrip("/") + "/"
    names = [(name, place.removeprefix(top)) for name, place, _ in sorted(listed(root), key=lambda f: -f[2])]
    files = spark.createDataFrame(names, "file string, path string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    whole = range_hashes(files.withColumn("byte_start", F.lit(0).cast("bigint")).withColumn("byte_end", F.lit(None).cast("bigint")))
    return whole.select("path", F.col("file_bytes").alias("bytes"), "sha256", category(F.col("path")).alias("category"))


def reconcile(declared: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """MISSING, MODIFIED, NEW or SAME per key."""
    a = declared.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_ina"))
    b = actual.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_inb"))
    status = F.when(F.col("_inb").isNull(), "MISSING").when(F.col("_ina").isNull(), "NEW").when(
        F.col("_a").eqNullSafe(F.col("_b")), "SAME").otherwise("MODIFIED")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted; empty means equal."""
    counted = left.withColumn("_d", F.lit(1)).unionByName(right.withColumn("_d", F.lit(-1)))
    return counted.groupBy(*left.columns).agg(F.sum("_d").alias("excess")).filter("excess <> 0")


#: digits of the key hash that make a leaf of the digest tree; part of the digest's definition
DIGEST_DEPTH = 4


def set_digest(rows: DataFrame, key: str, digest: str, salt: str, depth: int = DIGEST_DEPTH) -> DataFrame:
    """One digest of a whole keyed set that does not depend on row order.

    A hash tree: rows fall into 16^depth groups by the leading hex digits of the
    key hash, and each level drops one digit, so above the leaves no group holds
    more than sixteen digests.  The depth belongs to the digest: equal sets have
    equal digests whatever their size, and a deeper tree is another digest.
    """
    leaf = F.concat_ws("|", F.col(key).cast("string"), F.col(digest))
    level = rows.select(F.left(F.md5(F.col(key).cast("string")), F.lit(depth)).alias("_g"), leaf.alias("_d"), F.lit(1).cast("bigint").alias("n"))
    for digits in range(depth, -1, -1):
        hashed = F.sha2(F.concat(F.lit(salt), F.array_join(F.array_sort(F.collect_list("_d")), "\n")), 256)
        level = level.groupBy("_g").agg(hashed.alias("_d"), F.sum("n").alias("n"))
        level = level.select(F.left("_g", F.lit(max(digits - 1, 0))).alias("_g"), "_d", "n")
    return level.select("n", F.col("_d").alias("digest"))
