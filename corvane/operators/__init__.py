"""Relational operators over corpus relations: DataFrames in, DataFrames out."""
