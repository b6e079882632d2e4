"""Column expressions: calendar flags, risk buckets, weather factors."""
