"""Column expressions and query-text parsers."""
