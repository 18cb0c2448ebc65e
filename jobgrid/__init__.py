"""jobgrid: a Spark-native job-listing aggregation engine.

Every operator is a plain function from DataFrames to DataFrames built on
Catalyst expressions; see README.md for the module map."""

__version__ = "0.1.0"
