"""Column expressions and small dense numerics."""
