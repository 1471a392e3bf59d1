"""Operators on daily bars: return series, filters, the universe, industries and merging."""
