"""Typed-delta analytics on Spark: DataFrames whose schemas say how changes combine."""
