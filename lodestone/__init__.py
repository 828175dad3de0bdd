"""Lodestone: retrieval and text-corpus analytics expressed as Spark DataFrames."""
