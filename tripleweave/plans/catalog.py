"""All checked queries; importing this module fills the registry."""

from . import catalog_files, catalog_patterns, catalog_results, catalog_scalars

LOADED = (catalog_patterns, catalog_results, catalog_scalars, catalog_files)
