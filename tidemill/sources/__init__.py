"""Stored shards: file systems, manifests and commits."""
