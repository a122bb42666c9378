"""Tool calls linked to their results, ordered, checked and serialised, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.functions.ranking import split_row_number
from alertweft.session import materialise

#: variant type names of the JSON types a schema may ask for
KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<", "object": "^OBJECT<",
}
#: turns numbered by one task at a time
TURNS = 1024


def argument_errors(schemas: dict[str, dict[str, dict]], name: Column, raw: Column) -> Column:
    """Sorted array of what is wrong with the arguments of a call.

    ``schemas`` maps a tool to its fields; a field has ``type``, and may have
    ``required``, ``enum`` (of strings) and ``minimum``.  Fields a schema does not name are errors.
    """
    parsed = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike(KINDS["object"]), F.lit(False))
    nothing = F.array().cast("array<string>")

    def field_errors(field: str, rule: dict) -> Column:
        value = F.try_variant_get(parsed, f"$.{field}", "variant")
        given = F.array_contains(F.json_object_keys(raw), field)
        fits = F.coalesce(F.schema_of_variant(value).rlike(KINDS[rule["type"]]), F.lit(False))
        checks = [F.when(~given & F.lit(bool(rule.get("required"))), F.lit(f"missing {field}")), F.when(given & ~fits, F.lit(f"type {field}"))]
        if "enum" in rule:
            checks.append(F.when(given & fits & ~F.try_variant_get(parsed, f"$.{field}", "string").isin(rule["enum"]), F.lit(f"enum {field}")))
        if "minimum" in rule:
            checks.append(F.when(given & fits & (F.try_variant_get(parsed, f"$.{field}", "double") < rule["minimum"]), F.lit(f"minimum {field}")))
        return F.array_compact(F.array(*checks))

    cases = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        known = F.array(*[F.lit(f) for f in fields]) if fields else nothing
        extra = F.transform(F.array_except(F.json_object_keys(raw), known), lambda k: F.concat(F.lit("extra "), k))
        found = F.concat(*[field_errors(f, r) for f, r in sorted(fields.items())], extra) if fields else extra
        cases = F.when(name == tool, F.when(is_object, found).otherwise(F.array(F.lit("not an object")))).otherwise(cases)
    return F.array_sort(F.array_distinct(cases))


def anchors(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, steps) of every call with one dependency: the nearest call upwards that has none or several.

    Every round replaces a call's pointer by that of the call it points to, so a
    chain of n calls takes log2 n rounds.  While some call is left that does not
    hang on a cycle, each round settles one; when a round settles none, the
    rest hang on cycles and are left out.
    """
    key = ["conv_id", "call_id"]
    single = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("anchor")).where("n = 1")
    at = materialise(single.select(*key, "anchor", F.lit(1).alias("steps")), "tool-chains")
    before = None
    while True:
        over = at.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        state = at.join(over, ["conv_id", "anchor"], "left")
        waiting = state.where("next IS NOT NULL").count()
        if waiting in (0, before):
            return materialise(state.where("next IS NULL").select(*key, "anchor", "steps"), "tool-anchors")
        before = waiting
        at = materialise(state.select(
            *key, F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "tool-chains")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the distinct calls whose dependencies can be put in order.

    A call without dependencies has level 0, any other one more than the deepest
    of them.  Chains of calls with one dependency each are folded first, see ``anchors``.
    What is left are calls with several; every round settles those that wait for settled
    ones only, is written, and works on the rest, so there are as many rounds as
    such calls follow each other.  Calls on a cycle, or behind one, get no level.
    """
    key = ["conv_id", "call_id"]
    # a dependency on a call that is not there does not hold a call back
    edges = calls.select(*key, F.explode(F.array_distinct("after")).alias("parent")).distinct()
    there = calls.select("conv_id", F.col("call_id").alias("parent")).distinct()
    edges = materialise(edges.join(there, ["conv_id", "parent"]), "tool-edges")
    folded = anchors(edges)
    several = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    # a dependency that hangs on a cycle stays as it is and is never settled
    up = folded.select("conv_id", F.col("call_id").alias("parent"), "anchor", "steps")
    rest = materialise(edges.join(several, key).join(up, ["conv_id", "parent"], "left").select(
        *key, F.coalesce("anchor", "parent").alias("parent"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "tool-edges")
    done = materialise(calls.select(*key).distinct().join(edges, key, "left_anti").withColumn("level", F.lit(0)), "tool-levels")
    settled, parts = done, [done]
    while not rest.isEmpty():
        state = rest.join(
            settled.select("conv_id", F.col("call_id").alias("parent"), F.col("level").alias("_level")), ["conv_id", "parent"], "left")
        ready = state.groupBy(*key).agg(
            F.count(F.lit(1)).alias("_all"), F.count("_level").alias("_known"), F.max(F.col("_level") + F.col("steps")).alias("level")
        ).where("_all = _known").select(*key, "level")
        fresh = materialise(ready, "tool-levels")
        if fresh.isEmpty():
            break
        parts.append(fresh)
        settled = reduce(DataFrame.unionByName, parts)
        rest = materialise(rest.join(fresh, key, "left_anti"), "tool-edges")
    base = settled.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("_level"))
    chained = folded.join(base, ["conv_id", "anchor"]).select(*key, (F.col("_level") + F.col("steps")).alias("level"))
    return settled.unionByName(chained)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """(conv_id, position, call_id, name, level, n_results, valid, errors, record) of every call and stray result.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and after
    (ids of calls it builds on); ``results`` has conv_id, turn, call_id, content.
    Calls meet their results by (conv_id, call_id); of several results the
    earliest is used and the number is kept.  Positions are topological inside a
    conversation: by level, then turn and id; calls without an order come last.
    A repeated id is an error of every call after the first, and a null id, a null
    name, arguments that are not an object, a missing result, an unknown or cyclic
    dependency are errors too.  A result without a call is a row of its own, at
    the end.  ``record`` is canonical JSON: keys sorted at every depth, no white
    space.  Further columns are not read, and empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments", "after")
    # repeated results are reduced before they are shuffled; ties in the turn fall to the smaller content
    first = results.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_results"), F.min(F.struct(F.col("turn").cast("long").alias("turn"), "content")).alias("_first"))
    opening = calls.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy(*key).agg(
        F.min("turn").alias("_opens"), F.count(F.lit(1)).alias("_same"))
    known = calls.where("call_id IS NOT NULL AND conv_id IS NOT NULL")
    order = levels(known.withColumn("after", F.coalesce("after", F.array().cast("array<string>"))))
    missing = known.select(*key, F.explode("after").alias("parent")).join(
        opening.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_anti").groupBy(*key).agg(
        F.count(F.lit(1)).alias("_missing"))
    joined = calls.join(opening, key, "left").join(first, key, "left").join(order, key, "left").join(missing, key, "left")
    has_id = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    own = F.array_compact(F.array(
        F.when(~has_id, F.lit("no id")), F.when(has_id & (F.col("_same") > 1) & (F.col("turn") > F.col("_opens")), F.lit("repeated id")),
        F.when(has_id & F.col("n_results").isNull(), F.lit("no result")), F.when(has_id & F.col("level").isNull(), F.lit("cyclic dependency")),
        F.when(F.col("_missing") > 0, F.lit("unknown dependency")),
    ))
    linked = joined.select(
        "conv_id", "turn", "call_id", "name", "level", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.try_parse_json("arguments").alias("_arguments"), F.col("_first.content").alias("_result"),
        F.array_sort(F.concat(own, F.coalesce(argument_errors(schemas, F.col("name"), F.col("arguments")), F.array(F.lit("unknown tool"))))).alias("errors"))
    stray = first.join(opening.select(*key), key, "left_anti").select(
        "conv_id", F.col("_first.turn").alias("turn"), "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"),
        "n_results", F.try_parse_json(F.lit(None).cast("string")).alias("_arguments"), F.col("_first.content").alias("_result"),
        F.array(F.lit("no call")).alias("errors"))
    rows = linked.unionByName(stray)
    # fields in the order of their names
    record = F.to_json(F.struct(
        F.col("_arguments").alias("arguments"), "call_id", "name", F.col("_result").alias("result")), {"ignoreNullFields": "false"})
    last = F.when(F.array_contains("errors", "no call"), 2).when(F.col("level").isNull(), 1).otherwise(0)
    ready = rows.select(
        "conv_id", "turn", "call_id", "name", "level", "n_results", (F.size("errors") == 0).alias("valid"), "errors", record.alias("record"),
        last.alias("_last"))
    place = F.struct(F.col("_last"), F.coalesce("level", F.lit(0)).alias("level"), F.floor(F.coalesce("turn", F.lit(0)) / TURNS).alias("block"))
    numbered = split_row_number(ready, ["conv_id"], place, [F.col("turn"), F.col("call_id"), F.col("record")], "position")
    return numbered.select("conv_id", "position", "call_id", "name", "level", "n_results", "valid", "errors", "record")
