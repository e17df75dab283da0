"""Code-search and code-graph analytics on Spark."""
