"""Operators on DataFrames of photos, pairs, ratings and projects."""
