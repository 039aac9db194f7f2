"""Scalar functions: time, time ranges of imports, validation."""
