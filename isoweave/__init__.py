"""Splice-aware protein sequence analysis on PySpark DataFrames."""
