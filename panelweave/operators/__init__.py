"""Spark operators of panels: cutting, combining, merging, sampling, consolidating."""
