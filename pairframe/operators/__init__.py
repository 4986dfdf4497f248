"""Operators on tables of paired events: DataFrame in, DataFrame out."""
