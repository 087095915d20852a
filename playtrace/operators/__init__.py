"""Transformations and metrics: DataFrame in, DataFrame out."""
