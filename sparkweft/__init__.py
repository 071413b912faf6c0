"""Dependency-graph and vulnerability analytics over a portfolio of projects, as Spark DataFrames."""
