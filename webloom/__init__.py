"""Webloom: an analytics engine for acquired web data, built on Spark DataFrames."""

__version__ = "0.1.0"
