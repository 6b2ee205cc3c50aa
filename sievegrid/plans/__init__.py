"""plans of sievegrid."""
