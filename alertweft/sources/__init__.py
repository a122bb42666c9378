"""Readers and writers for event logs, archives, packages and run records."""
