"""Column -> Column functions, and their DuckDB twins for the SQL checks."""
