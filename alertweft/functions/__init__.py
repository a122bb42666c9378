"""Column-level helpers; all are JVM expressions."""
