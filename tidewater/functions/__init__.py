"""Column-returning functions: scalars, aggregates, elementwise mathematics."""
