"""Security-alert triage analytics on Spark: every operator is DataFrame in, DataFrame out."""
