"""Column functions: counter-based draws, text forms of values."""
