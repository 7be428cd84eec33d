"""Spark jobs over bundles of scanned pages and the registry they belong to."""

__version__ = "0.1.0"
