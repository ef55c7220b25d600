"""HTML trees, CSS selectors and extraction."""
