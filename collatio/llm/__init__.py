"""Operators of a training-data pipeline over text, pages and vectors.

Nothing else in the package imports this subpackage; deleting it leaves the rest whole.
"""
