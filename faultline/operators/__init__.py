"""operators of the change-impact engine."""
