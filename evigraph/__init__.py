"""evigraph: evidence-grounded family knowledge graphs on Spark DataFrames."""

__version__ = "0.1.0"
