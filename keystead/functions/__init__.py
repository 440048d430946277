"""Column functions: every one takes columns and returns a column."""
