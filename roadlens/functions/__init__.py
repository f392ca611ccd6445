"""Column functions: no Python runs on rows."""
