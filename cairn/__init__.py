"""Part of the confidence-graph engine."""
