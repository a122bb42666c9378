"""op5: repeated passages removed from the documents."""

from alertweft.llm import substrings
from alertweft.llm.common import table
from alertweft.llm.registry import query


@query("op5_substrings")
def op5_substrings(spark, folder):
    """Words left in every document once 13-word windows of earlier documents are gone."""
    return substrings.removed_words(table(spark, folder, "documents"), window=13, period=7)
