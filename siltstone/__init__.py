"""Analytics engine for retrieval pipelines on PySpark DataFrames."""
