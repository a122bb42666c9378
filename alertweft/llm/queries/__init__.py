"""One module per group of registered queries."""
