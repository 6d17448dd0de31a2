"""DuckDB oracle: the test-table bindings and report SQL, for result checks."""
