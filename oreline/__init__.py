"""Tabular analytics and mining operators for Spark: every operator takes DataFrames and returns a DataFrame."""
