"""prepspark: profiling, cleaning and feature preparation of large tables on PySpark.

Every operator is a small *fit* (one or a few aggregations whose result has one
row per column or per category) followed by a lazy DataFrame expression.
"""
