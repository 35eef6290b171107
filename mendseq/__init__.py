"""Correct substitution errors in DNA sequencing reads with Spark."""
