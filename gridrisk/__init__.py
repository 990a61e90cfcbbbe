"""Gridded environmental risk on Spark: cell-by-day tables, rare-event models, verification.

Operators are plain functions from DataFrames to DataFrames that take their column names as
parameters; column functions return Spark Columns.
"""
