"""Operators on whole tables: DataFrames in, a lazy DataFrame out."""
