"""Relational, statistical and data-quality operators on DataFrames."""
