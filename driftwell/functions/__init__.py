"""Column expressions, and the small row-local helpers that columns can't express."""
