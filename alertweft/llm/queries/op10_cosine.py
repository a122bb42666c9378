"""op10: near-duplicate classes of the embeddings."""

from alertweft.llm import cosine
from alertweft.llm.common import table
from alertweft.llm.registry import query

SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
    SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
walk(start, node) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT w.start, l.b FROM walk w JOIN l ON l.a = w.node),
r AS (SELECT start, min(node) AS component_id FROM walk GROUP BY start)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN r ON r.start = e.vec_id"""


@query("op10_cosine", SQL)
def op10_cosine(spark, folder):
    """Links and components of all embeddings at cosine 0.93 within a label."""
    return cosine.near_duplicates(table(spark, folder, "embeddings"), threshold=0.93)
