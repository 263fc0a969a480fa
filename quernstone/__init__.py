"""Quernstone: developer-knowledge analytics on Spark DataFrames."""
