"""Column expressions on vectors."""
