"""Corpus-curation and retrieval analytics on PySpark DataFrames."""
