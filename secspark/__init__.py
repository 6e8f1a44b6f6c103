"""Security-event analytics on PySpark DataFrames, in batch and in streams."""
