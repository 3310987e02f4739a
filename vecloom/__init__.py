"""PySpark-native vector search and analytics over ordinary DataFrames."""

__version__ = "0.1.0"
