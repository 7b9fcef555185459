"""Column expressions and array helpers."""
