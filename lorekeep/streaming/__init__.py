"""streaming of the package."""
