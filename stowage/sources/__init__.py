"""Readers and writers: tables, YAML catalogs, manifests, blobs."""
