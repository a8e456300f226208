"""Files, archives, RDF formats and tables as triples."""
