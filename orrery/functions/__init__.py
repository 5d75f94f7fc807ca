"""Column-returning functions."""
