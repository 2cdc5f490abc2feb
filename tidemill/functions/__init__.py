"""Natural order, digests and fingerprints as Columns."""
