"""Column functions, hash keys, and distributed order statistics."""
