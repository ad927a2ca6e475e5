"""Column expressions and shared distributed primitives."""
