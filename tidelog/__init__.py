"""Change-data and training-data engine on Spark DataFrames."""

__version__ = "0.1.0"
