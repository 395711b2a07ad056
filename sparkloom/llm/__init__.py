"""Operators for large text corpora, and the queries that apply them.

Nothing outside this folder imports it; ``queries.py`` lists the queries.
"""
