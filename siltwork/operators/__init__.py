"""Operators of the evaluation engine."""
