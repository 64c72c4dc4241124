"""Plans of the filing analytics engine."""
