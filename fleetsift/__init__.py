"""Fleet log analytics as PySpark DataFrames and Structured Streaming queries."""
