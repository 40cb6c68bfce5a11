"""Readers of catalogs, table metadata, manifests and object listings."""
