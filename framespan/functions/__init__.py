"""Scalar functions on columns and plan-time values."""
