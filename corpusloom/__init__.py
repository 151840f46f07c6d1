"""Corpus analytics on Spark package."""
