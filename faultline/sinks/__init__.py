"""Reports of analysis results."""
