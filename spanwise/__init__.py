"""Spanwise: band-join analytics and query operators for Spark DataFrames."""
