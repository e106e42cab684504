"""Readers that produce line or event DataFrames."""
