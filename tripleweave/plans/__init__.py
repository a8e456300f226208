"""Whole jobs: result sinks and the driver that runs sources, ingest, query and sinks."""
