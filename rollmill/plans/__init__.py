"""Query catalogue (Spark plan and SQL twin of each operator) and plan helpers."""
