"""Operators on DataFrames of pages."""
