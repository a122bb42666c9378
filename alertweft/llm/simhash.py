"""SimHash near-duplicates: BK-trees over fingerprint shards, components over their links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from xxhash import xxh64_digest

from alertweft.llm.common import Union, components, sorted_groups, text_bytes, whole_row
from alertweft.session import materialise, ship

ship(__name__)

SEED = 42
#: fingerprints in one BK-tree; larger shards are cut into several trees
TREE_SIZE = 2048
#: shingles whose bits are counted at a time
STEP = 1 << 16
#: near copies: words of a shingle, and share of the shingles of both texts that they have in common
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: min-hashes of a band and bands; texts that agree in a whole band meet, at similarity 0.8 all but 1 in 20,000 pairs
ROWS, BANDS = 5, 25
#: agreeing min-hashes below which a pair that met is not compared: six standard deviations under 0.8
PROMISING = 0.58
#: texts and bytes of shingles in one part of a band or cluster; a task holds two parts
PART, PART_BYTES = 1024, 2 << 20


def digests(text: bytes | None, shingle: int) -> list[bytes]:
    """Eight bytes for every word shingle of an UTF-8 text; a shorter text is one shingle, no words give none."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    if len(words) < shingle:
        return [xxh64_digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    sizes = list(map(len, words))
    ends = list(accumulate(n + 1 for n in sizes))
    return [xxh64_digest(joined[end - size - 1 : last - 1], SEED) for end, size, last in zip(ends, sizes, ends[shingle - 1 :])]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of an UTF-8 text; no words give zero."""
    return _simhash(digests(text, shingle))


def _simhash(found: list[bytes]) -> int:
    if not found:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), STEP):
        raw = np.frombuffer(b"".join(found[at : at + STEP]), dtype=np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    narrow = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return narrow.mapInArrow(run, schema)


def shard_masks(radius: int) -> list[int]:
    """Bit masks such that two fingerprints within ``radius`` bits agree under at least one.

    ``radius`` differing bits leave one of radius + 1 bit blocks untouched, and
    again one of the radius + 1 blocks of the other bits.  Blocks are interleaved,
    so bits that flip together are spread over all of them.
    """
    parts, masks = radius + 1, []
    for block in range(parts):
        kept = [i for i in range(64) if i % parts == block]
        rest = [i for i in range(64) if i % parts != block]
        for second in range(parts):
            masks.append(sum(1 << i for i in kept + rest[second::parts]))
    return masks


class BKTree:
    """Burkhard-Keller tree of integers under Hamming distance."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert; a child is keyed by its distance to the parent.  Returns the item's number."""
        new, at = len(self.items), 0
        self.items.append(value)
        self.children.append({})
        while new:
            distance = (self.items[at] ^ value).bit_count()
            at_next = self.children[at].setdefault(distance, new)
            if at_next == new:
                break
            at = at_next
        return new

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the items within ``radius``; only edges within the radius are followed."""
        found, stack = [], [0] if self.items else []
        while stack:
            at = stack.pop()
            distance = (self.items[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                if len(children) <= 2 * radius + 1:
                    stack.extend(c for d, c in children.items() if distance - radius <= d <= distance + radius)
                else:
                    for d in range(distance - radius, distance + radius + 1):
                        if d in children:
                            stack.append(children[d])
        return found


def tree_links(values: list[int], split: int, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one tree group: the first ``split`` values form the tree.

    The others only probe it; with no others the tree's own values probe it as
    they come in.
    """
    tree, union = BKTree(), Union(len(values))
    for i in range(split):
        if split == len(values):
            for j in tree.near(values[i], radius):
                union.join(i, j)
        tree.add(values[i])
    for i in range(split, len(values)):
        for j in tree.near(values[i], radius):
            union.join(i, j)
    return [(i, root) for i in range(len(values)) if (root := union.find(i)) != i]


def links(fps: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp`` at most ``radius`` bits apart.

    A shard holds the fingerprints that agree under one mask.  Each tree goes to
    the rows of its shard only: a shard larger than ``tree_size`` is cut into
    trees, and every tree meets every other part of that shard once, so no task
    holds more than two parts and no pair is lost.
    """
    masks = shard_masks(radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)]
    entries = fps.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree_size).cast("int")
    members = entries.join(sizes, "shard").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    meets = members.withColumn("own", own).select(
        "shard", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        "shard", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
        (F.col("own") > F.col("other")).cast("int").alias("probe"), "fp",
    )
    placed = meets.repartition("shard", "left", "right").sortWithinPartitions("shard", "left", "right", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for group in sorted_groups(batches, ["shard", "left", "right"]):
            values = group.column("fp").to_numpy().view(np.uint64).tolist()
            alone = group.column("left")[0].as_py() == group.column("right")[0].as_py()
            split = len(values) if alone else len(values) - int(group.column("probe").to_numpy().sum())
            for i, j in tree_links(values, split, radius):
                out_a.append(values[i])
                out_b.append(values[j])
            if len(out_a) > 50_000:
                yield _pairs(out_a, out_b)
                out_a, out_b = [], []
        yield _pairs(out_a, out_b)

    return placed.mapInArrow(run, "a long, b long").distinct()


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    columns = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id): near-duplicate class of every row.

    Rows link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable.  Null and wordless texts have
    the fingerprint zero and link like any other.  Rows with a null id take part
    but never name a class, so a class of such rows only has a null
    ``component_id``; repeated rows each get the same answer; other columns are
    not read.  Equal fingerprints are reduced to one before anything is compared.
    Long texts are read whole, STEP shingles at a time; an empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    unique = fps.groupBy("fp").agg(F.min("id").alias("first"))
    labels = components(links(unique.select("fp"), radius), "simhash-links").withColumnsRenamed({"node": "fp"})
    rooted = unique.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: str | Column = "fp") -> Column:
    """The fingerprint as 16 lowercase hex digits."""
    column = F.col(fp) if isinstance(fp, str) else fp
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def sketch(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bands, signature) of a text's shingles: one long per band, and one byte per min-hash."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, size=ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    hashes = np.frombuffer(b"".join(found), dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, np.multiply.outer(factors, hashes[at : at + 1024]).min(axis=1))
    bands = [int.from_bytes(xxh64_digest(row.tobytes(), i), "big", signed=True) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    # mixed once more, because the upper bits of a minimum are nearly always zero
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return np.array(bands, dtype=np.int64), (mixed >> np.uint64(56)).astype(np.uint8)


def forest(signatures: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest, by largest agreement, of the pairs that agree in PROMISING of their min-hashes."""
    n, at, out = len(signatures), 0, []
    best, source, waiting = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for _ in range(n - 1):
        waiting[at] = False
        near = np.count_nonzero(signatures == signatures[at], axis=1) / signatures.shape[1]
        closer = waiting & (near > best)
        best[closer], source[closer] = near[closer], at
        at = int(np.where(waiting, best, -2).argmax())
        if best[at] >= PROMISING:
            out.append((int(source[at]), at))
    return out


def _tiles(members: DataFrame, by: str, parts: Column, inside: bool) -> DataFrame:
    """The members (by, key, ...) dealt to pairs of parts (left, right); ``inside``: a part also meets itself."""
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    if not inside:  # two parts that meet are compared inside as well
        others = F.filter(others, lambda o: (F.col("parts") == 1) | (o != F.col("own")))
    placed = members.withColumn("parts", parts.cast("int")).withColumn("own", own).withColumn("other", F.explode(others))
    dealt = placed.withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")).drop("other", "parts")
    return dealt.repartition(by, "left", "right").sortWithinPartitions(by, "left", "right")


def band_links(texts: DataFrame) -> DataFrame:
    """(a, b) spanning links between texts (key, bands, signature) that meet in a band and may be similar."""
    entries = texts.select("key", F.explode("bands").alias("band"))
    sizes = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = entries.join(sizes, "band").join(texts.select("key", "signature"), "key")
    placed = _tiles(members, "band", F.ceil(F.col("n") / PART), inside=False).select("band", "left", "right", "key", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["band", "left", "right"]):
            keys = group.column("key").to_numpy()
            found = np.array(forest(np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(keys), -1)), dtype=np.int64)
            if len(found):
                yield _links(keys[found[:, 0]], keys[found[:, 1]])

    return placed.mapInArrow(run, "a long, b long")


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def similar(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles (key, grams) are common to both by ``similarity`` of all."""
    both = pairs.join(grams.select(F.col("key").alias("a"), F.col("grams").alias("left")), "a").join(
        grams.select(F.col("key").alias("b"), F.col("grams").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def set_links(sets: list[np.ndarray], known: np.ndarray, split: int, similarity: float) -> list[tuple[int, int]]:
    """Spanning links of similar sets of shingles: among all of them, or with a ``split`` from those before it to the others.

    ``known`` numbers classes that are linked already.  Sets become rows of bits, so one
    row is compared with all others by counting the bits that differ.
    """
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    width = -(-len(unique := np.unique(every)) // 64) * 64 or 64
    bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for i, values in enumerate(sets):
        row = np.zeros(width, dtype=bool)
        row[np.searchsorted(unique, values)] = True
        bits[i] = np.packbits(row).view(np.uint64)
    sizes, label, out = np.array([len(v) for v in sets]), known.copy(), []
    for i in range(len(sets) if split == len(sets) else split):
        first = i + 1 if split == len(sets) else split
        room = np.minimum(sizes[first:], sizes[i]) >= similarity * np.maximum(sizes[first:], sizes[i]) - 1e-9
        for some in np.array_split(others := first + np.flatnonzero(room & (label[first:] != label[i])), len(others) // 256 + 1):
            differ = np.bitwise_count(bits[some] ^ bits[i]).sum(axis=1, dtype=np.int64)
            shared = (sizes[some] + sizes[i] - differ) // 2
            for j in some[shared >= similarity * (sizes[some] + sizes[i] - shared) - 1e-9].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def cluster_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links between the classes of each cluster, from (cluster, key, class, grams): no similar pair of a cluster is left unlinked.

    A cluster is cut into parts of bounded size and every two parts meet in a
    task, which sends on only links that join two classes.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("grams")).alias("bytes"))
    sized = members.join(sizes, "cluster")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("bytes") / PART_BYTES))
    placed = _tiles(sized, "cluster", F.greatest(parts, F.lit(1)), inside=True).select("cluster", "left", "right", "own", "key", "class", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cluster", "left", "right"]):
            own, left = group.column("own").to_numpy(), group.column("left")[0].as_py()
            group = group.take(pa.array(np.argsort(own != left, kind="stable")))
            keys, alone = group.column("key").to_numpy(), left == group.column("right")[0].as_py()
            sets = [np.frombuffer(v, np.uint64) for v in group.column("grams").to_pylist()]
            split = len(keys) if alone else int((own == left).sum())
            found = np.array(set_links(sets, group.column("class").to_numpy(), split, similarity), dtype=np.int64)
            if len(found):
                yield _links(keys[found[:, 0]], keys[found[:, 1]])

    return placed.mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, grams) of texts (key, text): their distinct shingle hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(b"".join(digests(t, shingle)), np.uint64)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "grams"])

    return texts.select("key", "text").mapInArrow(run, "key long, grams binary")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE,
                     similarity: float = SIMILARITY, radius: int = 2) -> DataFrame:
    """One row of every class of near copies, the one with the smallest id.

    Two texts are near copies when ``similarity`` of their distinct word shingles
    are common to both; classes are what such pairs connect.  Pairs are proposed
    by the BK-trees over SimHash fingerprints and by bands of min-hashes, because
    a fingerprint radius wide enough for 0.8 (about 15 bits) has no selective
    shards.  Links of a band span all its pairs that may be similar, and are compared
    exactly.  Where that leaves several classes in what the links connect, the classes
    go on being compared, text by text, until no similar pair is left between them.

    Null and wordless texts are copies of each other.  Rows are told apart by id and text
    (its SHA-256), so a class without any id keeps one row too, and an id with two texts
    loses only the copy; of rows that repeat id and text the one whose JSON is least stays.
    Long texts are taken whole, as sets of their shingles.  An empty table
    stays empty.  All columns of a row stay as they are, whatever their names.
    """
    digest = F.unhex(F.sha2(F.coalesce(text_bytes(text_col), F.lit(b"")), 256))
    narrow = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.coalesce(text_bytes(text_col), F.lit(b"")).alias("text"))
    schema = T.StructType([
        T.StructField("id", narrow.schema["id"].dataType), T.StructField("digest", T.BinaryType()), T.StructField("fp", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands, signatures = [], [], []
            for text in batch.column(2).to_pylist():
                found = digests(text, shingle)
                own, signature = sketch(found)
                fps.append(_simhash(found))
                bands.append(own)
                signatures.append(signature.tobytes())
            columns = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=schema.names)

    rows = materialise(narrow.mapInArrow(run, schema), "copies-sketch")
    order = F.struct(F.col("id").isNull().alias("unknown"), "id")
    least = rows.groupBy("digest").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("fp", "bands", "signature")])
    # texts are numbered, so that no two share a key; the numbers hold once they are written
    texts = materialise(least.withColumn("key", F.monotonically_increasing_id()), "copies-texts")
    # each fingerprint is stood for by its smallest key; the others of that fingerprint meet it
    stand = texts.groupBy("fp").agg(F.min("key").alias("stand"))
    same = texts.join(stand, "fp").select(F.col("stand").alias("a"), F.col("key").alias("b"))
    near = links(stand.select("fp"), radius)
    near = near.join(stand.select(F.col("fp").alias("a"), F.col("stand").alias("x")), "a").join(stand.select(F.col("fp").alias("b"), F.col("stand").alias("y")), "b")
    proposed = band_links(texts).unionByName(same).unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    pairs = materialise(proposed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "copies-pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "digest"), "key")
    met = narrow.select("digest", "text").join(used, "digest").dropDuplicates(["key"])
    grams = materialise(shingle_sets(met, shingle), "copies-grams")
    passed = materialise(similar(pairs, grams, similarity), "copies-passed")
    classes = components(passed, "copies-links").withColumnsRenamed({"node": "key", "root": "class"})
    clusters = components(pairs, "copies-clusters").withColumnsRenamed({"node": "key", "root": "cluster"})
    placed = clusters.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    unsettled = placed.groupBy("cluster").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("cluster")
    more = cluster_links(placed.join(unsettled, "cluster").join(grams, "key"), similarity)
    labels = components(passed.unionByName(more), "copies-all").withColumnsRenamed({"node": "key"})
    best = texts.select("key", "digest", "first").join(labels, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(
        F.min(F.struct("first", "digest")).alias("best")).select(F.col("best.first.id").alias("id"), F.col("best.digest").alias("digest"))
    both = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])
    counted = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    gone = materialise(counted.alias("c").join(best.alias("b"), both(counted, best), "left_anti").select("id", "digest"), "copies-gone")
    again = materialise(counted.where("n > 1").select("id", "digest"), "copies-again")
    whole = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    kept = whole.join(gone, both(whole, gone), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, both(kept, again), "left_anti").select("row")
    one = kept.join(again, both(kept, again), "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(one.select("row")).select("row.*")
