"""One thin query per operator over the given tables."""
