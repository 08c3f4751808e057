"""Batch analytics on PySpark whose results can be checked, traced and minimised."""
