"""Sensitive-text analytics on Spark: detection, masking, auditing and reporting over DataFrames."""

__version__ = "0.1.0"
