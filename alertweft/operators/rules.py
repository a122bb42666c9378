"""Trigger rules: nested predicates compiled to one Column, lint, and rule replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import FORBIDDEN_RULE_FIELDS
from alertweft.functions.text import sql_text, str_array

INT_FIELDS = {"event_code"}


class RuleError(ValueError):
    """A rule that cannot be evaluated or that uses a forbidden field."""


def field_sql(path: str) -> str:
    """SQL of a dotted path; a missing step gives null.

    ``attributes.x`` and ``derived.x`` read the maps, ``attributes.record.a.b``
    reads the nested record (a variant), anything else is a plain column.
    """
    head, _, rest = path.partition(".")
    if head in ("attributes", "derived") and rest:
        if rest.startswith("record."):
            return f"try_variant_get(record, {sql_text('$.' + rest[len('record.'):])}, 'string')"
        return f"{head}[{sql_text(rest)}]"
    return f"`{path}`"


def field_column(path: str) -> Column:
    return F.expr(field_sql(path))


def _java_regex(pattern: str) -> str:
    # Python classes and case folding are Unicode-aware, Java's only with these flags
    return ("(?iuU)" if "(?i" in pattern[:5] and "i" in pattern[2:4] else "(?U)") + pattern


def _leaf(field: str, op: str, value, resolve) -> str:
    actual = resolve(field)
    same_type = lambda v: isinstance(v, int) == (field in INT_FIELDS) and not isinstance(v, bool)
    literal = lambda v: str(v) if isinstance(v, int) else sql_text(v)
    if op == "in":
        if not isinstance(value, list):
            return "false"
        typed = [literal(v) for v in value if v is not None and same_type(v)]
        test = f"coalesce({actual} in ({', '.join(typed)}), false)" if typed else "false"
        return f"({test} or {actual} is null)" if None in value else test
    if op == "eq":
        # typed equality: a number never equals its text form
        return f"coalesce({actual} = {literal(value)}, false)" if same_type(value) else "false"
    left, right = f"cast({actual} as string)", str(value)
    low, folded = f"lower({left})", sql_text(right.lower())
    tests = {
        "ieq": f"{low} = {folded}",
        "contains": f"contains({left}, {sql_text(right)})",
        "icontains": f"contains({low}, {folded})",
        "startswith": f"startswith({left}, {sql_text(right)})",
        "istartswith": f"startswith({low}, {folded})",
        "endswith": f"endswith({left}, {sql_text(right)})",
        "iendswith": f"endswith({low}, {folded})",
        "regex": f"rlike({left}, {sql_text(_java_regex(right))})",
    }
    if op not in tests:
        raise RuleError(f"unsupported predicate operator: {op}")
    # two-valued logic: a missing field makes the leaf false, so its negation is true
    return f"coalesce({tests[op]}, false)"


def predicate_sql(node: dict, resolve=field_sql) -> str:
    """A predicate tree as one SQL boolean without nulls."""
    if "all" in node:
        return "(" + " and ".join(predicate_sql(c, resolve) for c in node["all"]) + ")" if node["all"] else "true"
    if "any" in node:
        return "(" + " or ".join(predicate_sql(c, resolve) for c in node["any"]) + ")" if node["any"] else "false"
    if "not" in node:
        return f"(not {predicate_sql(node['not'], resolve)})"
    return _leaf(node["field"], node["op"], node["value"], resolve)


def predicate(node: dict, resolve=field_sql) -> Column:
    """A predicate tree as a boolean Column."""
    return F.expr(predicate_sql(node, resolve))


def predicate_fields(node: dict) -> list[str]:
    for key in ("all", "any"):
        if key in node:
            return [f for child in node[key] for f in predicate_fields(child)]
    return predicate_fields(node["not"]) if "not" in node else [node["field"]]


def rule_fields(rule: dict) -> list[tuple[str, str]]:
    """(part, field) pairs a rule reads: predicate, scope, group_by, distinct."""
    found = [("predicate", f) for f in predicate_fields(rule["event_predicate"])]
    scope = rule.get("scope", {}).get("filter_predicate")
    found += [("scope", f) for f in (predicate_fields(scope) if scope else [])]
    aggregation = rule.get("aggregation") or {}
    found += [("group_by", f) for f in aggregation.get("group_by", [])]
    if aggregation.get("distinct"):
        found.append(("distinct", aggregation["distinct"]["field"]))
    return found


def lint(rule: dict) -> list[str]:
    """Forbidden locator or label fields a rule touches (empty when clean)."""
    return [
        f"{part}: {field}"
        for part, field in rule_fields(rule)
        if {p.lower() for p in field.split(".")} & set(FORBIDDEN_RULE_FIELDS)
    ]


def forbidden_field(field: Column) -> Column:
    """Column form of the lint for rule fields held in a table."""
    parts = F.transform(F.split(field, r"\."), F.lower)
    return F.arrays_overlap(parts, str_array(FORBIDDEN_RULE_FIELDS))


def _flattened(events: DataFrame, rules: list[dict]) -> tuple[DataFrame, dict[str, str]]:
    """Pull every map entry the rules read into a plain column, once per event."""
    paths = sorted({
        f for rule in rules for _, f in rule_fields(rule)
        if "." in f and (not f.startswith("attributes.record.") or "record" in events.columns)
    })
    names = {path: f"_f{i}" for i, path in enumerate(paths)}
    return events.selectExpr("*", *[f"{field_sql(p)} as {n}" for p, n in names.items()]), names


def _resolver(columns: set[str], names: dict[str, str]):
    def resolve(field):
        if field in names:
            return names[field]
        return f"`{field}`" if field in columns else "cast(null as string)"

    return resolve


def _scope_and_match(rule: dict, resolve) -> tuple[str, str]:
    scope = rule.get("scope", {}).get("filter_predicate")
    in_scope = predicate_sql(scope, resolve) if scope else "true"
    return in_scope, f"({in_scope} and {predicate_sql(rule['event_predicate'], resolve)})"


def match_rules(events: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per (event, matching rule), all rules evaluated in a single scan."""
    flat, names = _flattened(events, rules)
    resolve = _resolver(set(events.columns), names)
    arms = ", ".join(f"case when {_scope_and_match(rule, resolve)[1]} then {sql_text(rule['case_id'])} else '' end" for rule in rules)
    # outer explode: an inner one would infer a filter on the hit array, and pushing that filter
    # below the projections above would evaluate every rule twice, on inlined attribute lookups
    tagged = flat.selectExpr(*[f"`{c}`" for c in events.columns], f"array_remove(array({arms}), '') as _hits")
    return tagged.select(*events.columns, F.explode_outer("_hits").alias("rule_case")).filter(F.col("rule_case").isNotNull())


def funnel(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Raw, scope and predicate counts of every rule in one aggregation without a shuffle of rows."""
    flat, names = _flattened(events, rules)
    resolve = _resolver(set(events.columns), names)
    sums = ["count(1) as raw"]
    for i, rule in enumerate(rules):
        in_scope, match = _scope_and_match(rule, resolve)
        sums += [f"count_if({in_scope}) as s{i}", f"count_if({match}) as m{i}"]
    counts = flat.agg(*map(F.expr, sums))
    rows = ", ".join(
        f"struct({sql_text(rule['case_id'])} as case_id, raw as raw_events, s{i} as scope_events, m{i} as predicate_matches)"
        for i, rule in enumerate(rules))
    return counts.select(F.inline_outer(F.expr(f"array({rows})")))
