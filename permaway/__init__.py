"""permaway: a Spark-first engine for the geometry of linear tracks.

Drawn paths and tabular centerlines are DataFrames of ordered points; geodesy,
splines, resampling and ordered analytics are Column expressions over them.
"""

__version__ = "0.1.0"
