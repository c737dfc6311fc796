"""Column builders and fixed vocabularies."""
