"""Query registry: Spark plans per operator and their DuckDB oracle text."""
