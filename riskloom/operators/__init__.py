"""Operators: DataFrame in, DataFrame out; a fit may run small aggregate jobs."""
