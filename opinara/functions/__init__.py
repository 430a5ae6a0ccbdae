"""Column expressions (JVM side, no Python workers)."""
