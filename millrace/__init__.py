"""millrace: batch analytics on PySpark DataFrames."""
