"""sources of the change-impact engine."""
