"""streaming of sievegrid."""
