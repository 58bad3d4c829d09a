"""Spark-native engine for public-sector records: names, identifiers, releases,
audits and identity resolution, as functions on columns and DataFrames."""

__version__ = "0.2.0"
