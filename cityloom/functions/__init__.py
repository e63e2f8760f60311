"""Column expressions: names, dates, geometry, smoothing, moments."""
