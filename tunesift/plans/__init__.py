"""Registered queries: each pairs a DataFrame plan with its DuckDB oracle SQL."""
