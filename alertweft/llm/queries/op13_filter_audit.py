"""op13: what five filters remove from the documents, in all 120 orders."""

from alertweft.llm import filter_audit
from alertweft.llm.common import table
from alertweft.llm.registry import query

SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
        CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN coalesce(w.doc_id > least, least IS NOT NULL) THEN 'E' ELSE '' END AS failed
    FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (
    SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, failed,
        contains(failed, filter_order[step]) AS fails, len(translate(filter_order[1:step - 1], failed, '')) = step - 1 AS there FROM c, s),
g AS (
    SELECT part, filter_order, step, letter, sum(n) FILTER (WHERE there AND NOT fails) AS kept, sum(n) FILTER (WHERE there AND fails) AS removed,
        sum(n) FILTER (WHERE fails AND NOT there) AS redundant, sum(n) FILTER (WHERE failed = letter) AS unique_fails,
        sum(good) FILTER (WHERE there AND fails) AS good_lost, sum(toxic) FILTER (WHERE there AND fails) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g"""


@query("op13_filter_audit", SQL)
def op13_filter_audit(spark, folder):
    """Totals of every step of every order, per source."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
