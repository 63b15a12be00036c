"""Lodestone: document retrieval and corpus processing on Spark DataFrames."""
