"""Preparation, curation and scoring of page-layout annotations on Spark DataFrames."""

__version__ = "0.1.0"
