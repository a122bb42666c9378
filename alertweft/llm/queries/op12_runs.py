"""op12: periodic runs of words in the documents, a tenth of which repeat a block of their own."""

from pyspark.sql import functions as F

from alertweft.llm import runs
from alertweft.llm.common import table
from alertweft.llm.registry import query


def with_repeats(docs):
    """Documents whose hashed id ends in 0 go on with a block of their own words, over and over, from a hashed place on."""
    rows = docs.select(
        "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"),
        F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "").alias("words"))
    sized = rows.select("doc_id", "text", "h", "words", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    block = placed.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return block.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


@query("op12_runs")
def op12_runs(spark, folder):
    """Number of runs, longest run and digests of every document."""
    return runs.periodic_runs(with_repeats(table(spark, folder, "documents"))).drop("n_words")
