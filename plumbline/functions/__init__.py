"""Column expressions: distances and cells, remapping, ranks."""
