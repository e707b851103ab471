"""Provenance-first knowledge analytics on Spark."""
