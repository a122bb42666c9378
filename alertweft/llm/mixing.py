"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its share of the byte budget over its own bytes.
Every document draws its number of copies from the Poisson distribution with
that mean by inverting it at a uniform number hashed from a seed and the
document, so a rerun, a retried task or another partitioning draws the same.
Copies are dealt to partitions and ordered by a hash, which mixes all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertweft.llm.common import whole_row

REST = "*"
#: steps of a distribution that are gathered at a time
BLOCK = 256


def hashed(seed: str, *parts: Column) -> Column:
    """Hex digest of a seed and some columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"))


def uniform(digest: Column) -> Column:
    """[0, 1) from the first 52 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... until nothing is left in double precision.

    Terms are summed from their logarithms, so large rates do not underflow.  They are gathered
    in blocks, as an array that grows by one element is copied for each.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def add(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    def add_block(blocks: Column, low: Column) -> Column:
        before = F.element_at(blocks, -1)
        start = F.struct(before["log"].alias("log"), before["sum"].alias("sum"), F.array().cast("array<double>").alias("steps"))
        return F.concat(blocks, F.array(F.aggregate(F.sequence(low, F.least(last, low + (BLOCK - 1))), start, add)))

    blocks = F.aggregate(F.sequence(F.lit(1), last, F.lit(BLOCK)), F.array(first), add_block)
    return F.flatten(F.transform(blocks, lambda b: b["steps"]))


def rates(docs: DataFrame, weights: dict[str, float], rest: float, text_col: str = "text", source_col: str = "source",
          budget_bytes: int | None = None) -> DataFrame:
    """(class, rate) of every named source and of all others together; at most one row per weight plus one."""
    if min([rest, *weights.values()]) < 0 or REST in weights:
        raise ValueError("weights are not negative, and '*' is not a source")
    scale = sum(weights.values()) + rest
    kind = source_class(weights, source_col)
    sizes = docs.groupBy(kind.alias("class")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("bytes"))
    budget = F.lit(budget_bytes).cast("long") if budget_bytes is not None else F.col("total")
    share = F.coalesce(*[F.when(F.col("class") == s, F.lit(w / scale)) for s, w in weights.items()], F.lit(rest / scale))
    # a window over all classes, of which there are no more than weights
    totals = sizes.withColumn("total", F.sum("bytes").over(W.partitionBy()))
    return totals.select("class", (share * budget / F.col("bytes")).alias("rate"))


def source_class(weights: dict[str, float], source_col: str = "source") -> Column:
    named = F.col(source_col).isin(list(weights)) if weights else F.lit(False)
    return F.when(named, F.col(source_col)).otherwise(F.lit(REST))


def replicate(docs: DataFrame, weights: dict[str, float], rest: float, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", budget_bytes: int | None = None, seed: str = "mix", plain: bool = False) -> DataFrame:
    """The columns of ``docs`` with ``n_copies``, ``copy`` and ``shuffle_key``, one row per copy, globally shuffled.

    ``weights`` are the target shares of named sources and ``rest`` that of all
    other rows, null sources included; they are scaled to one.  ``budget_bytes``
    is the size aimed at, by default that of ``docs``.  A weight of zero leaves a
    source out.  A row without an id draws by its text; repeated rows draw alike;
    a null text has one byte.
    Columns named like the three new ones are replaced, all others stay; with ``plain``
    nothing is added or replaced.  An empty table stays empty.
    """
    # the table of rates is as long as the weights given, not as the data
    table = rates(docs, weights, rest, text_col, source_col, budget_bytes).select("class", poisson_steps(F.col("rate")).alias("steps"))
    who = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    added = () if plain else ("n_copies", "copy", "shuffle_key")
    drawn = docs.select(
        whole_row(docs, *added).alias("row"), source_class(weights, source_col).alias("class"), who.alias("who"))
    counted = drawn.withColumn("u", uniform(hashed(seed, F.col("who")))).join(F.broadcast(table), "class").withColumn(
        "n_copies", F.size(F.filter("steps", lambda c: c <= F.col("u"))))
    copies = counted.where("n_copies > 0").select("row", "who", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.substring(hashed(seed, F.col("who"), F.col("copy")), 1, 16))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("row.*", *added)
