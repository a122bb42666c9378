"""Filter interaction audit: what each of several filters removes, in every order they can be applied in.

Documents are counted by the set (mask) of filters they fail.  Orders are ranked
lexicographically, as their Lehmer codes are; all orders that begin alike are an
interval of ranks.  A mask is removed at step s by the orders whose first s - 1 filters
it passes and whose s-th it fails: a few intervals.  So each count is added at
the first rank of an interval and taken off behind its last, and one prefix
sum over the ranks gives what every step of every order removes.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertweft.session import materialise

#: the five filters of a document, in the order of the bits of a mask
NAMES = "ABCDE"
_SPACE = "[\\x20\\x09-\\x0D]+"


def intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last) of every removal; neighbours are joined."""
    nodes = []

    def walk(before: int, first: int, step: int) -> None:
        size = factorial(filters - step)
        for place, at in enumerate(i for i in range(filters) if not before >> i & 1):
            start = first + place * size
            nodes.append((before, at, step, start, start + size))
            if step < filters:
                walk(before | 1 << at, start, step + 1)

    walk(0, 0, 1)
    out: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << filters):
        hit = sorted((step, first, end) for before, at, step, first, end in nodes if mask >> at & 1 and not mask & before)
        for step, first, end in hit:
            if out and out[-1][:2] == (mask, step) and out[-1][3] == first:
                out[-1] = (mask, step, out[-1][2], end)
            else:
                out.append((mask, step, first, end))
    return out


def order_totals(counts: DataFrame, names: str) -> DataFrame:
    """What every step of every order removes, from (part, mask, n, good, toxic).

    One row per part, order of the letters ``names`` (ascending) and step, zeros
    included: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.  The table of counts holds at most 2^filters rows a part.
    """
    spark, size = counts.sparkSession, len(names)
    ranks = factorial(size)
    counts = materialise(counts, "audit-counts")
    ways = spark.createDataFrame(intervals(size), "mask int, step int, first int, last int")  # fixed by the number of filters
    values = ("n", "good", "toxic")
    ends = counts.join(F.broadcast(ways), "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("first").alias("rank"), *values), F.struct(F.col("last").alias("rank"), *[(-F.col(v)).alias(v) for v in values]))).alias("d"))
    changes = ends.select("part", "step", "d.*").where(F.col("rank") < ranks)
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), *[F.lit(0).cast("long").alias(v) for v in values])
    summed = grid.unionByName(changes).groupBy("part", "step", "rank").agg(*[F.sum(v).alias(v) for v in values])
    running = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    lost = summed.select("part", "step", "rank", *[F.sum(v).over(running).alias(v) for v in values])
    orders = F.array(*[F.lit("".join(o)) for o in permutations(sorted(names))])
    lost = lost.withColumn("filter_order", F.get(orders, F.col("rank"))).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    letters = F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(names)])).alias("l")
    fails = counts.select("part", "mask", "n", letters).groupBy("part", "l.letter").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("l.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("mask") == F.col("l.bit"), F.col("n")).otherwise(0)).alias("unique_fails"))
    so_far = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return lost.join(fails, ["part", "letter"]).select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(W.partitionBy("part", "letter")).alias("shapley"))


def failed(text: Column) -> list[Column]:
    """The conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail, and the labelled ones among them.

    Filters: A under 50 words, B under 65 percent distinct words, C over 5 percent
    capitals, D one of ``#$%&*|``, E a text that a smaller id has anywhere.  Texts are
    known by their SHA-256, and the smallest id of a text is found by minima
    over (text, part, mask, label) groups, so rows of a text that many share are
    reduced before they meet.

    A null text is empty and a null part ''.  A row without an id has no label; it fails E if
    any row with an id has its text and never makes another fail.  Rows that repeat
    the smallest id and its text all pass E.  An id with several labels takes the larger.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    bits = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed(F.col("text"))))
    rows = known.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    # rows without an id are spread by their text; they match no label
    spread = rows.withColumn("key", F.coalesce(F.xxhash64("id"), F.xxhash64("digest")))
    marked = spread.join(
        named.withColumn("label_key", F.xxhash64("label_id")), (F.col("key") == F.col("label_key")) & (F.col("id") == F.col("label_id")), "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    groups = marked.select("digest", "part", "mask", *flags, "n", F.when(F.col("id").isNotNull(), F.struct("id", "n")).alias("row")).groupBy(
        "digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
    first = F.min("row.id").over(W.partitionBy("digest"))
    settled = groups.select("part", "mask", "good", "toxic", "n", F.when(F.col("row.id") == first, F.col("row.n")).when(first.isNull(), F.col("n")).otherwise(0).alias("passing"))
    split = settled.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("s"))
    return split.select("part", "good", "toxic", "s.*").where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``order_totals`` of the five filters of ``masks``; an empty table has no parts and no rows, other columns are not read."""
    return order_totals(masks(docs, labels, id_col, text_col, part_col), NAMES)
