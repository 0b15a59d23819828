"""Relational rule learning and analytics on Spark."""
