"""op6: tool calls and results read out of the conversations."""

from pyspark.sql import functions as F

from alertweft.llm import toolcalls
from alertweft.llm.common import table
from alertweft.llm.registry import query

_FIELDS = {"query": {"type": "string", "required": True}, "limit": {"type": "integer", "minimum": 20}, "options": {"type": "object"}}
SCHEMAS = {"search": _FIELDS, "lookup": {**_FIELDS, "limit": {"type": "number", "required": True}}}


def calls_and_results(conversations):
    """An assistant turn as a call whose form follows its numbers, a user turn as the result of the turn before."""
    conv, turn = F.col("conv_id"), F.col("turn")
    call_id = lambda t: F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), t.cast("string"))
    word, size, form = F.regexp_extract("text", "[a-z]+", 0), F.length("text").cast("string"), (conv * 7 + turn) % 11
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    arguments = (
        F.when(form == 0, text('{"limit": "', size, '", "query": "', word, '"}')).when(form == 1, text('{"limit": ', size, "}"))
        .when(form == 2, text('{"query": "', word, '", "limit": ', size, ', "depth": 1}')).when(form == 3, F.lit('{"query": '))
        .when(form == 4, F.lit("[1]"))
        .otherwise(text('{"query": "', word, '", "options": {"z": true, "a": [1, null, "x"]}, "limit": ', size, "}")))
    kind = (conv + turn) % 4
    name = F.when(kind < 2, "search").when(kind == 2, "lookup").otherwise("run")
    after = F.when((turn == 1) & (conv % 5 == 0), F.array(call_id(F.lit(3)))).when(
        (turn >= 2) & ((conv + turn) % 3 == 0), F.array(call_id(turn - 2)))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", call_id(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = conversations.where("role = 'user'").select("conv_id", "turn", call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SQL = """
WITH RECURSIVE a AS (
    SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, regexp_extract(text, '[a-z]+') AS w, length(text) AS n,
        (conv_id * 7 + turn) % 11 AS f, CASE WHEN (conv_id + turn) % 4 < 2 THEN 'search' WHEN (conv_id + turn) % 4 = 2 THEN 'lookup' ELSE 'run' END AS name,
        CASE WHEN turn = 1 AND conv_id % 5 = 0 THEN 'c' || conv_id || '-3'
             WHEN turn >= 2 AND (conv_id + turn) % 3 = 0 THEN 'c' || conv_id || '-' || (turn - 2) END AS parent
    FROM conversations WHERE role = 'assistant'),
r AS (
    SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, count(*) AS n_results, min(turn) AS turn, arg_min(text, turn) AS content
    FROM conversations WHERE role = 'user' GROUP BY ALL),
walk(conv_id, call_id, level) AS (
    SELECT conv_id, call_id, 0 FROM a WHERE parent IS NULL OR parent NOT IN (SELECT call_id FROM a)
    UNION ALL SELECT a.conv_id, a.call_id, w.level + 1 FROM walk w JOIN a ON a.parent = w.call_id AND a.conv_id = w.conv_id),
c AS (
    SELECT a.conv_id, a.turn, a.call_id, a.name, walk.level, coalesce(r.n_results, 0) AS n_results,
        list_sort(list_filter([
            CASE WHEN r.call_id IS NULL THEN 'no result' END, CASE WHEN walk.call_id IS NULL THEN 'cyclic dependency' END,
            CASE WHEN a.parent IS NOT NULL AND a.parent NOT IN (SELECT call_id FROM a) THEN 'unknown dependency' END,
            CASE WHEN a.name = 'run' THEN 'unknown tool' WHEN f IN (3, 4) THEN 'not an object' END,
            CASE WHEN a.name <> 'run' AND f = 0 THEN 'type limit' END, CASE WHEN a.name <> 'run' AND f = 1 THEN 'missing query' END,
            CASE WHEN a.name <> 'run' AND f = 2 THEN 'extra depth' END,
            CASE WHEN a.name = 'search' AND f NOT IN (0, 3, 4) AND n < 20 THEN 'minimum limit' END], lambda e: e IS NOT NULL)) AS errors,
        '{"arguments":' || CASE f WHEN 0 THEN '{"limit":"' || n || '","query":"' || w || '"}' WHEN 1 THEN '{"limit":' || n || '}'
            WHEN 2 THEN '{"depth":1,"limit":' || n || ',"query":"' || w || '"}' WHEN 3 THEN 'null' WHEN 4 THEN '[1]'
            ELSE '{"limit":' || n || ',"options":{"a":[1,null,"x"],"z":true},"query":"' || w || '"}' END
            || ',"call_id":"' || a.call_id || '","name":"' || a.name || '","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS record
    FROM a LEFT JOIN r USING (conv_id, call_id) LEFT JOIN walk USING (conv_id, call_id)),
u AS (
    SELECT *, CASE WHEN level IS NULL THEN 1 ELSE 0 END AS last FROM c
    UNION ALL
    SELECT conv_id, turn, call_id, NULL, NULL, n_results, ['no call'],
        '{"arguments":null,"call_id":"' || call_id || '","name":null,"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}', 2
    FROM r WHERE call_id NOT IN (SELECT call_id FROM a))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY last, coalesce(level, 0), turn, call_id, record) AS position,
    call_id, name, CAST(level AS INTEGER) AS level, n_results, len(errors) = 0 AS valid, array_to_string(errors, ', ') AS errors, record FROM u"""


@query("op6_toolcalls", SQL)
def op6_toolcalls(spark, folder):
    """Every call and stray result of the conversations, linked, ordered, checked and serialised."""
    found = toolcalls.link(*calls_and_results(table(spark, folder, "conversations")), SCHEMAS)
    return found.withColumn("errors", F.array_join("errors", ", "))
