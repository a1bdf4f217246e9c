"""Tallyframe: reconcile two versions of the same data with Spark DataFrames."""

__version__ = "0.1.0"
