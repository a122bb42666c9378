"""Relational operators: projection, rules, sessions, redaction, packages, scoring, audits."""
