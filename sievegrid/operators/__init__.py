"""operators of sievegrid."""
