"""Text helpers: literal replacement, phrase search, id extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from alertweft.fixed import EVIDENCE_ID


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def str_array(values) -> Column:
    """A literal array of strings (empty lists keep the element type)."""
    values = list(values)
    return F.expr(f"array({', '.join(map(sql_text, values))})" if values else "cast(array() as array<string>)")


def str_map(pairs: dict[str, str]) -> Column:
    """A literal map of strings."""
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in pairs.items()) + ")")


def joined(array: Column, sep: str = "|") -> Column:
    """Sorted, separator-joined text of an array: the CSV form of a list column."""
    return F.array_join(F.array_sort(array), sep)


def labels(tests: list[tuple[Column, str]]) -> Column:
    """Array of the labels whose test is true, in order.

    Built with ``array_remove`` because a higher-order filter would take the
    tests out of generated code.
    """
    return F.array_remove(F.array(*[F.when(test, label).otherwise("") for test, label in tests]), "")


def evidence_ids(text: Column, ignore_case: bool = True) -> Column:
    """Distinct evidence ids cited in a text, upper-cased when case is ignored."""
    pattern = ("(?i)" if ignore_case else "") + EVIDENCE_ID
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    if ignore_case:
        # ids hold no space, so all are upper-cased as one text, without a lambda that would leave generated code
        found = F.array_remove(F.split(F.upper(F.array_join(found, " ")), " "), "")
    return F.array_distinct(found)


def _alternation(phrases) -> str:
    """Any of the phrases; their first characters are looked for before the phrases are tried one by one."""
    quoted = [re.sub(r"([^A-Za-z0-9 ])", r"\\\1", p) for p in phrases]
    if not all(phrases):
        return "|".join(quoted)
    first = "".join(sorted({re.sub(r"([^A-Za-z0-9 ])", r"\\\1", p[0]) for p in phrases}))
    return f"(?=[{first}])(?:{'|'.join(quoted)})"


def first_phrase(text: Column, phrases) -> Column:
    """The first phrase of the list contained in the lower-cased text, else null."""
    low = F.lower(text)
    return F.when(low.rlike(_alternation(phrases)), F.get(F.filter(str_array(phrases), lambda p: F.contains(low, p)), F.lit(0)))


def any_phrase(text: Column, phrases) -> Column:
    """True when the lower-cased text contains one of the phrases, in one pass over the text."""
    return F.coalesce(F.lower(text).rlike(_alternation(phrases)), F.lit(False))


def unescape_entities(text: Column) -> Column:
    """The five XML entities, ampersand first."""
    # Entity order is part of the result.
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def replace_all(text: Column, mapping: dict[str, str]) -> Column:
    """Apply literal replacements one after the other, in mapping order."""
    for source, target in mapping.items():
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


def occurrences(text: Column, literal: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / F.lit(len(literal))).cast("bigint")


def snake_case(name: Column) -> Column:
    """camelCase and punctuation to snake_case."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.trim(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", "_"), F.lit("_")))


def domain_user(domain: Column, user: Column) -> Column:
    """``DOMAIN\\user`` with the separator trimmed when one part is empty."""
    return F.trim(F.concat(F.coalesce(domain, F.lit("")), F.lit("\\"), F.coalesce(user, F.lit(""))), F.lit("\\"))
