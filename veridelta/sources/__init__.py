"""Parsers of patches, coverage, logs, manifests, reports and documents, as functions of line tables."""
