"""Text measurement over Spark DataFrames."""

__version__ = "0.2.0"
