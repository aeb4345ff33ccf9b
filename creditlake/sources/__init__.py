"""Readers: driver parquet tables, test adapters, typed CSV, JDBC, synthetic rows."""
