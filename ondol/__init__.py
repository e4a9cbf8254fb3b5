"""Quote, case and corpus analytics on PySpark DataFrames."""
