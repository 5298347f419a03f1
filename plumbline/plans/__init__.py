"""Named queries over the benchmark tables."""
