"""Operators on DataFrames of tracks, samples, windows and annotations."""
