"""Paperwork reconciliation and corpus jobs on Spark DataFrames."""
