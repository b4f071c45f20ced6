"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
queries and SQL that the entry module registers when the folder is present.
"""
