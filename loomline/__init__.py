"""Loomline: analytics over conversation and activity timelines, as PySpark DataFrames."""
