"""Operators for large text corpora: filtering, joins, mixing, sharding, formatting and scoring.

Nothing outside this package imports it.
"""
