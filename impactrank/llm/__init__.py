"""Operators for large training-data pipelines, each written as Spark jobs.

Nothing else in the library imports this subpackage.
"""
