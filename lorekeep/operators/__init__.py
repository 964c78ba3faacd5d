"""operators of the package."""
