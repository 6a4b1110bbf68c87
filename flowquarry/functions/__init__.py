"""Column expressions: cleaning, geometry, statistics."""
