"""Claim and portfolio analytics on Spark: declarative operators over DataFrames."""

__version__ = "0.1.0"
