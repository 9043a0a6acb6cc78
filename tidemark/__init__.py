"""Tidemark: Spark-first operators for timestamped product reviews.

Every operator is a function from DataFrames to a DataFrame.  Catalyst plans
the work; Python workers are used only where no built-in expression exists.
"""

__all__ = ["session"]
