"""helixmill: k-mer analytics and record processing on Spark DataFrames."""

__version__ = "0.1.0"
