"""Reusable plan fragments: distributed quantiles, ordered totals, hash cuts, lookups."""
