"""plans of the change-impact engine."""
