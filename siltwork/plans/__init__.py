"""Plans of the evaluation engine."""
