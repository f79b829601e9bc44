"""Column helpers: everything here returns Column expressions or projections."""
