"""cubeweave: error-bounded reduction and analysis of dense arrays, and training-data operators, on Spark DataFrames."""

__version__ = "0.1.0"
