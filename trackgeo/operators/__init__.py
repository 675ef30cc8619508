"""Operator families: each function takes DataFrames and returns DataFrames."""
