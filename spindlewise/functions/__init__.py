"""Column expressions: calendar buckets, model names, units and report text."""
