"""Operators of a training-data pipeline: URL filters, secret scans, quality
rules, BPE encoding, exact and near-duplicate removal, vector search, packing
and license scans.  Nothing else in the library imports this subpackage."""
