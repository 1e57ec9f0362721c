"""Registered queries (with their DuckDB oracle SQL) built from the operators."""
