"""Leakage-safe studies on labelled sample-by-feature tables, on Spark.

Every function takes and returns DataFrames (or Columns).  Rows of a matrix
stay distributed; only model parameters and class or fold sized summaries ever
reach the driver.
"""

__version__ = "0.1.0"
