"""Whole jobs made of the operators: the ingest cycle and the reader."""
