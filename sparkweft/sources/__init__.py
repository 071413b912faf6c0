"""Corpus readers: manifests and vulnerability feeds as DataFrames."""
