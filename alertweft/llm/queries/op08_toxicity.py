"""op8: toxicity of the documents."""

from pyspark.sql import functions as F

from alertweft.llm import toxicity
from alertweft.llm.common import bucket_of, table
from alertweft.llm.registry import query


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    """Score of every document by classifiers fitted outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), mod=4, held_out=2)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
