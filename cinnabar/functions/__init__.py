"""Scalar scores, on numbers and on columns."""
