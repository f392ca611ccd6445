"""DataFrame operators with columns as parameters."""
