"""Sources of the filing analytics engine."""
