"""sources of sievegrid."""
