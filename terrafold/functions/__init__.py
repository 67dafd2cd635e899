"""Column expressions: coding rules, projections, distributions."""
