"""The shipped trigger rules and their taxonomy, whole documents in ``rules.json``.

Users load their own rules from JSON with :func:`rules_from_json`; nothing
here is special-cased in the engine.
"""

from __future__ import annotations

import json
from importlib.resources import files

_SHIPPED = json.loads(files(__package__).joinpath("rules.json").read_text(encoding="utf-8"))
FAMILIES: dict[str, list[str]] = _SHIPPED["families"]
PATTERN_CASES: dict[str, list[str]] = {
    pattern: sorted(r["case_id"] for r in _SHIPPED["rules"] if r["analytic_pattern_id"] == pattern)
    for patterns in FAMILIES.values() for pattern in patterns
}


def rules() -> list[dict]:
    """All shipped rules, in the nested form of a rule document."""
    return json.loads(json.dumps(_SHIPPED["rules"]))


def rules_from_json(text: str) -> list[dict]:
    """Rule documents from JSON text (one object or an array)."""
    loaded = json.loads(text)
    return loaded if isinstance(loaded, list) else [loaded]


def taxonomy_rows() -> list[tuple[str, str, str]]:
    """(family, pattern, case) rows of the catalogue."""
    return [
        (family, pattern, case)
        for family, patterns in FAMILIES.items() for pattern in patterns for case in PATTERN_CASES[pattern]
    ]
