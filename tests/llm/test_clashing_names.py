"""Columns of the caller that are named like inner ones, in every operator that returns whole rows."""

import corpus_pipeline as P
import pytest
from alertweft.llm import kdtree, mixing, simhash, substrings, templates, toxicity
from test_substrings import got, slow

NAMES = ["_row", "_id", "_size", "_crc", "_k0", "_first", "_count", "_slice", "_n", "_offset", "_key", "_class", "_who", "_u", "_steps", "row", "key",
         "class", "who", "u", "steps", "id", "digest", "a.b", "score", "text_bytes", "target", "p"]


@pytest.fixture
def crowded(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "src0"), (2, "short", "en", None), (None, None, None, "src1"), (3, "", "en", "src1"), (2, "short", "en", None)]
    columns = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"{n}{i}" for n in NAMES]) for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, {columns}")


def kept_whole(found, docs, extra=()):
    """All columns are there in order, and every row is one of the input."""
    assert found.columns == [*docs.columns, *extra]
    before, rows = {tuple(r) for r in docs.collect()}, [tuple(r)[: len(docs.columns)] for r in found.collect()]
    assert set(rows) <= before
    return len(rows)


def test_rows_stay_whole(spark, crowded):
    assert kept_whole(kdtree.shard_documents(crowded, shards=2), crowded, ["shard", "slot"]) == 5
    assert kept_whole(mixing.replicate(crowded, {}, 1.0, budget_bytes=10_000), crowded, ["n_copies", "copy", "shuffle_key"]) > 5
    bench = spark.createDataFrame([(7, " ".join(f"word{i}" for i in range(3, 30)))], "item_id long, text string")
    assert kept_whole(templates.drop_leaks(crowded, bench), crowded) == 4
    assert kept_whole(simhash.drop_near_copies(crowded), crowded) == 3
    model = toxicity.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert kept_whole(toxicity.drop_toxic(crowded, model), crowded) == 5
    for name, stage in P.STAGES[1:]:
        assert stage(spark, crowded.limit(0), "/root/testdata/sf0.001").count() == 0, name


def test_rows_without_an_id_are_spread(spark, docs_of):
    """A table half of whose rows have no id, and one id that repeats, over many blocks."""
    rows = [(None if i % 2 else (7 if i % 4 else i), " ".join(f"w{(i * 3 + k) % 50}" for k in range(30)) + f" end{i}") for i in range(200)]
    blocks = substrings.removed_words(docs_of(rows), block_bytes=2000, bucket_bytes=1000)
    assert got(blocks) == slow(rows)
