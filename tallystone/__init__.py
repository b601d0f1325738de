"""Reconciliation, change-data and data-quality operators as Spark jobs.

Every operator is a function from DataFrames (and parameters) to a DataFrame,
or from Columns to a Column.  Nothing here collects rows to the driver.
"""
