"""Operators of training-data pipelines."""
