"""op1: SimHash near-duplicate classes of the documents."""

from alertweft.llm import simhash
from alertweft.llm.common import table
from alertweft.llm.registry import query


@query("op1_simhash")
def op1_simhash(spark, folder):
    """Fingerprint and class of every document: 3-word shingles, two bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")
