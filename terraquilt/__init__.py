"""Spatial tables on Spark: polygon overlay, equal-area measurement and the
table work around them, written with DataFrames and Columns."""
