"""Posting analytics and matching on Spark DataFrames."""
