"""Registered queries: library operators on the benchmark tables, with SQL twins."""
