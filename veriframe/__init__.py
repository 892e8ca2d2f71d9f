"""Claim verification and training-data operators on Spark."""
