"""Analytic operators: each takes DataFrames plus keyword filters and returns a DataFrame."""
