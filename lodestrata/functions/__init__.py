"""Column functions that carry the field rules."""
