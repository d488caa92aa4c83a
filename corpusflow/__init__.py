"""corpusflow: set-at-a-time analytics over text corpora and their review history, on Spark DataFrames."""

__version__ = "0.1.0"
