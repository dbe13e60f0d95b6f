"""Operators of a training-data pipeline: ten numbered operators, their queries and their SQL twins.

Nothing else in the library imports this package.
"""
