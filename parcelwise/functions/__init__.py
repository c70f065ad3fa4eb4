"""Column functions: cleaning, curves, distance."""
