"""The query registry (one query per inventory row) and the DuckDB oracle SQL."""
