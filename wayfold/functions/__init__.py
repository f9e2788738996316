"""Column expressions: projection, geometry, densities."""
