"""streaming of the change-impact engine."""
