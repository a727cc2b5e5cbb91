"""Column expressions and projections over JSON documents and collected arrays."""
