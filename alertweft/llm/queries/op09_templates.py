"""op9: documents that hold benchmark items, also re-parameterised ones."""

from alertweft.llm import templates
from alertweft.llm.common import table
from alertweft.llm.registry import query


@query("op9_templates")
def op9_templates(spark, folder):
    """Pairs of a document and a benchmark item in it, with how much of it and how many values differ."""
    found = templates.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "windows", "coverage", "n_slots", "changed").distinct()
