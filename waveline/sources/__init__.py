"""Reading, writing and keeping panel tables."""
