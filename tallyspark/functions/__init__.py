"""Functions of the filing analytics engine."""
