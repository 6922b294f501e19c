"""Tesserae: retrieval and analytics over text, vectors and tables on Spark DataFrames."""
