"""See the package docstring of corpusloom."""
