"""Relational operators on binding tables."""
