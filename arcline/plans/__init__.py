"""Batch jobs composed of the operators."""
