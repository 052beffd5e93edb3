"""Sources of the evaluation engine."""
