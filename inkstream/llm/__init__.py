"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
column names and returns a new DataFrame with its own output columns only, so
extra or clashing columns of the input never collide with results.
"""
