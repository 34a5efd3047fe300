"""Permutation-array analytics as DataFrame operators for Spark."""
