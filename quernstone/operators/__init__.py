"""Relational, retrieval, graph and similarity operators over DataFrames."""
