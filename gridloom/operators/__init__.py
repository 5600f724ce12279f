"""Operators over lattice fields held as DataFrames keyed by cell."""
