"""Column functions: address algebra, geometry, text and scores."""
