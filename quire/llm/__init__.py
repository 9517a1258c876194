"""Operators for training-data pipelines.

Nothing outside this folder imports it; ``queries`` registers the queries.
"""
