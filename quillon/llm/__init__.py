"""Operators of a large training-data pipeline; nothing else in the library imports them.

Each module has one general operator (DataFrames in, DataFrames out).  The
thin queries that fix the production parameters are in ``queries``.
"""
