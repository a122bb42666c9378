"""Structured Streaming versions of the rule and gate operators."""
