"""Operator families; every operator is a function from DataFrames to a DataFrame."""
