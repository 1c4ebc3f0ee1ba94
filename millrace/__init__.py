"""Millrace: screening and preparation of untrusted text as Spark DataFrames."""
