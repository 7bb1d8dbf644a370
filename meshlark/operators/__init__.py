"""Operators on topology documents: rules, graphs, allocation, retrieval, matching and plans."""
