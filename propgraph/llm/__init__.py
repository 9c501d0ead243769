"""Operators for preparing training data, on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
