"""Operators of a training-data pipeline (one module per operator).

Every operator reads DataFrames and returns DataFrames; the thin queries that fix
their parameters are in ``queries``. Nothing outside this package imports it.
"""
