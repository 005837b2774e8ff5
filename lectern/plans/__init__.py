"""Composite jobs (L1-L6) built from the operators: the public API."""
