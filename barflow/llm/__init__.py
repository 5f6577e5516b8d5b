"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; every module here works on
plain DataFrames and keeps its own documented behaviour for nulls, empty and very
long texts, repeated rows and empty tables.
"""
