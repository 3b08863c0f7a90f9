"""Composite queries: cleaning, weight correction, indicators, sizes, zones."""
