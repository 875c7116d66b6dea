"""Scriptorium: analytics over marked-up documents, written for Spark DataFrames."""

__version__ = "0.1.0"
