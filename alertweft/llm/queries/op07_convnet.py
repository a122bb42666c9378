"""op7: quality of the documents."""

from pyspark.sql import functions as F

from alertweft.llm import convnet
from alertweft.llm.common import bucket_of, table
from alertweft.llm.registry import query


@query("op7_convnet")
def op7_convnet(spark, folder):
    """Score of every document by a network fitted outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = convnet.train(docs, table(spark, folder, "labels"), mod=5, held_out=0)
    return convnet.score(docs, model).select(
        "doc_id", F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
