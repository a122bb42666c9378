"""Process lineage: walks over (guid, parent_guid) edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from alertweft.session import materialise


STRIDE = 4


def closure(edges: DataFrame) -> DataFrame:
    """(low, high, dist): every ancestor up to four steps above a process.

    A process has one parent, so the table is at most four times the edges; it
    serves walks in both directions and cuts their number of joins by four.
    Where no process has two parents and no chain ends in a cycle, the ancestors 8, 16, 32, ... steps above are
    listed too, as long as there are any: a walk then meets nothing twice and can double its depth every round.
    """
    one = materialise(edges.filter("guid <> parent_guid").select(F.col("guid").alias("low"), F.col("parent_guid").alias("high")).distinct(), "edges")
    hop = lambda a, b: a.select("low", F.col("high").alias("mid")).join(
        b.select(F.col("low").alias("mid"), "high"), "mid").select("low", "high")
    two = materialise(hop(one, one), "edges")
    three, four = hop(two, one), materialise(hop(two, two), "edges")
    forest = one.groupBy("low").count().filter("count > 1").isEmpty()
    jumps = _jumps(four, hop) if forest else {}
    # with jumps nothing reads the third step, which is then left to whoever asks for it
    steps = {1: one, 2: two, 3: three if jumps else materialise(three, "edges"), STRIDE: four, **jumps}
    return reduce(lambda a, b: a.unionByName(b), [s.withColumn("dist", F.lit(i)) for i, s in steps.items()])


def _jumps(four: DataFrame, hop) -> dict[int, DataFrame]:
    """Ancestors 8, 16, 32, ... steps above by repeated doubling; none at all when a chain has no end.

    Whatever the depth, fewer processes have an ancestor twice as far above; when
    all that are left still have one, they lie on a cycle or below one.
    """
    found, far, dist, left = {}, four, STRIDE, four.count()
    while left:
        far, dist, before = materialise(hop(far, far), "edges"), 2 * dist, left
        left = far.count()
        if left == before:
            return {}
        if left:
            found[dist] = far
    return found


def _walk(reach: DataFrame, anchors: DataFrame, up: bool) -> DataFrame:
    """(anchor, guid, depth) links; each round is one join of the frontier with the closure.

    Every round is written to the shared folder: the plan stays short however
    deep the walk is, and a lost executor costs one round only.  The walk ends
    when a round finds nothing new, which also ends cycles that reused ids create:
    a process is reached once per anchor, at its smallest depth.
    """
    here, there = ("low", "high") if up else ("high", "low")
    steps = reach.select(F.col(here).alias("node"), F.col(there).alias("guid"), "dist")
    if not reach.filter(F.col("dist") == 2 * STRIDE).isEmpty():
        return _doubled(steps, anchors)
    frontier = anchors.select(F.col("guid").alias("anchor"), F.col("guid").alias("node")).distinct()
    found = materialise(frontier.select("anchor", F.col("node").alias("guid"), F.lit(0).alias("depth")), "links")
    rounds, start = [found], 0
    while True:
        links = frontier.join(steps, "node").groupBy("anchor", "guid").agg((F.min("dist") + start).alias("depth"))
        for known in rounds:
            links = links.join(known.select("anchor", "guid"), ["anchor", "guid"], "left_anti")
        links = materialise(links, "links")
        if links.isEmpty():
            break
        start += STRIDE
        frontier = links.filter(F.col("depth") == start).select("anchor", F.col("guid").alias("node"))
        rounds = _compact([*rounds, links])
    return reduce(lambda a, b: a.unionByName(b), rounds).filter("depth > 0")


def _doubled(steps: DataFrame, anchors: DataFrame) -> DataFrame:
    """The links of a walk on which nothing is met twice: those up to depth n, moved on by n, give those up to 2 n.

    A link is written once, joined again in later rounds only, and needs no look at earlier ones.
    """
    links = anchors.select(F.col("guid").alias("anchor"), F.col("guid").alias("guid"), F.lit(0).alias("depth")).distinct()
    rounds, far = [], 1
    while True:
        known = reduce(lambda a, b: a.unionByName(b), [links, *rounds]).withColumnRenamed("guid", "node")
        moved = known.join(steps.filter(F.col("dist") == far).drop("dist"), "node").select("anchor", "guid", (F.col("depth") + far).alias("depth"))
        moved = materialise(moved, "links")
        if moved.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), [*rounds, moved])
        rounds.append(moved)
        far *= 2


def _compact(parts: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """Few tables instead of many, so that deep walks keep short plans."""
    if len(parts) < most:
        return parts
    return [materialise(reduce(lambda a, b: a.unionByName(b), parts), "links")]


def ancestors(reach: DataFrame, anchors: DataFrame) -> DataFrame:
    return _walk(reach, anchors, up=True)


def descendants(reach: DataFrame, anchors: DataFrame) -> DataFrame:
    return _walk(reach, anchors, up=False)


def roots(edges: DataFrame) -> DataFrame:
    """(guid, root, depth) of every process by pointer doubling: log2(depth) joins instead of depth joins.

    While chains are left, fewer pointers move in every round; those that never
    stop lie on a cycle or below one and get a null root and depth.
    """
    up = edges.select("guid", F.when(F.col("guid") != F.col("parent_guid"), F.col("parent_guid")).alias("to"))
    known = up.select(F.col("guid").alias("known"))
    jumps = up.join(known, up["to"] == known["known"], "left").select(
        "guid", F.col("known").alias("to"), F.when(F.col("known").isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"))
    jumps = materialise(jumps.select("guid", F.coalesce("to", "guid").alias("root"), "depth"), "jumps")
    before = None
    while True:
        nxt = jumps.select(F.col("guid").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        doubled = jumps.join(nxt, "root").select("guid", F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("depth2") > 0).alias("moved"))
        doubled = materialise(doubled, "jumps")
        moving = doubled.filter("moved").count()
        jumps = doubled.drop("moved")
        if moving == 0 or moving == before:
            still = F.when(~F.col("moved"), True)
            return doubled.select("guid", F.when(still, F.col("root")).alias("root"), F.when(still, F.col("depth")).alias("depth"))
        before = moving
