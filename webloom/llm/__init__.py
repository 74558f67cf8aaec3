"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; `webloom.llm.entry` holds the thin queries over whole tables.
"""
