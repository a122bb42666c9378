"""op11: the documents as token ids in binary record files."""

from pyspark.sql import functions as F

from alertweft.llm import records
from alertweft.llm.common import table
from alertweft.llm.registry import query
from alertweft.session import scratch_path

#: the tokenizer lower-cases and drops white space, so words can be encoded one by one
TOKENIZER, END = "word_bpe_49k.json", 1


@query("op11_records")
def op11_records(spark, folder):
    """Place, length and checksum of every document's ids, from the files that were written."""
    import public_tokenizers

    path = scratch_path(spark, "token-records")
    records.write(table(spark, folder, "documents"), path, public_tokenizers.path(TOKENIZER), END, by_words=True)
    return records.read(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
