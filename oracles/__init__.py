"""The registered queries and, for each, the same result as SQL for DuckDB."""
