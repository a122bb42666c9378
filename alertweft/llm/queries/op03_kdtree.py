"""op3: the documents dealt to sixteen shards of equal bytes."""

from pyspark.sql import functions as F

from alertweft.llm import kdtree
from alertweft.llm.common import table
from alertweft.llm.registry import query


@query("op3_kdtree")
def op3_kdtree(spark, folder):
    """Shard and slot of every document; the law is equal bytes."""
    placed = kdtree.assign(table(spark, folder, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
