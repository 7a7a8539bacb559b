"""DuckDB statements that state the expected result of each query."""
