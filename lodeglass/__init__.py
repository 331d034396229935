"""Spark-native code and document index: operators over DataFrames planned by Catalyst."""

__version__ = "0.1.0"
