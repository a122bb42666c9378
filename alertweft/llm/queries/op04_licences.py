"""op4: licences named in the documents."""

from pyspark.sql import functions as F

from alertweft.llm import licences
from alertweft.llm.common import table
from alertweft.llm.registry import query


@query("op4_licences")
def op4_licences(spark, folder):
    """Per document: paragraphs, licence paragraphs, confirmed families, and the surest finding."""
    docs = table(spark, folder, "documents")
    found = licences.scan(docs, licences.train(docs))
    sure = F.filter("findings", lambda f: f["confirmed"])
    top = F.array_max(F.transform(sure, lambda f: F.struct(f["probability"], f["family"], f["similarity"], f["paragraph"])))
    return found.select(
        "doc_id", "n_paragraphs", F.size("findings").alias("n_predicted"), F.size(sure).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), " ").alias("families"),
        top["family"].alias("family"), top["probability"].alias("probability"), top["similarity"].alias("similarity"),
        top["paragraph"].alias("paragraph"))
