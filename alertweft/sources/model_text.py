"""Decisions out of free model text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DECISION = "verdict string, severity string, confidence double, key_evidence array<string>, rationale string, recommended_action string"


def json_body(reply: Column) -> Column:
    """Text from the first opening to the last closing brace, code fences removed."""
    plain = F.regexp_replace(reply, "(?m)^```[a-zA-Z]*\\s*$", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))


def parse_decision(reply: Column) -> Column:
    """The decision struct, null when the reply holds no JSON object."""
    return F.from_json(json_body(reply), DECISION)
