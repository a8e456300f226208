"""Column functions over RDF terms."""
