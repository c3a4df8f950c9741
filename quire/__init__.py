"""Corpus analytics for e-books and other long documents, on Spark DataFrames."""
