"""functions of sievegrid."""
