"""Operators on marked-up documents: DataFrame in, DataFrame out."""
