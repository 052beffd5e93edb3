"""Functions of the evaluation engine."""
