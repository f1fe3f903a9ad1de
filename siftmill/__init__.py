"""siftmill: retrieval analytics over code and text corpora, built on Spark DataFrames."""

__version__ = "0.1.0"
