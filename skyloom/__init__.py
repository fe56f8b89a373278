"""Gridded time-series engine on Spark.

A cube of ``(t, y, x)`` cells is a table; axes are small tables; every product
operation is a DataFrame plan that ends in a single write.
"""
